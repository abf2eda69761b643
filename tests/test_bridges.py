"""Iso-surfaces, block shifts, seeds and signs on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminae.operators import bridges, dense, marching


def test_sphere_by_tetrahedra(spark):
    n, r = 16, 5.0
    rows = [(z, y, x, r - math.dist((z, y, x), (7.5, 7.5, 7.5))) for z in range(n) for y in range(n) for x in range(n)]
    rings = marching.sections(spark.createDataFrame(rows, "z long, y long, x long, v double"), 0.0)
    tris = marching.triangles(rings).cache()
    corners = tris.select(F.explode(F.array("a", "b", "c")).alias("p")).select(F.sqrt(sum(((F.col(f"p.{a}") - 7.5) ** 2 for a in "zyx"), F.lit(0.0))).alias("d"))
    assert corners.agg(F.max(F.abs(F.col("d") - r))).first()[0] < 0.15
    area = marching.triangle_shapes(tris).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(4 * math.pi * r * r, rel=0.05)
    # a closed surface: every edge has two triangles
    edges = tris.select(F.explode(F.array(*(F.sort_array(F.array(*(F.struct(*(F.round(F.col(f"{p}.{a}"), 6).alias(a) for a in "zyx")) for p in pair))) for pair in ("ab", "bc", "ca")))).alias("e")).filter("e[0] <> e[1]")
    assert edges.groupBy("e").count().filter("count % 2 <> 0").isEmpty()
    assert marching.sections(spark.createDataFrame([], "z long, y long, x long, v double"), 0.0).count() == 0


def test_phase_shift_of_a_block():
    rng = np.random.default_rng(4)
    block = rng.random((8, 8, 8))
    for shift in ((0, 0, 0), (1, -2, 3), (-3, 0, 4)):
        got, conf = dense.block_shift(block, np.roll(block, shift, (0, 1, 2)))
        assert got == list(shift) and conf == pytest.approx(1)
    assert dense.block_shift(np.zeros((4, 4, 4)), np.zeros((4, 4, 4)))[1] == 0


def test_seeds_and_signs(spark):
    seeds = spark.createDataFrame([(1, 9.0, 0.0), (2, 8.0, 1.0), (3, 7.0, 2.5), (4, 7.0, 4.0), (5, 1.0, 40.0)], "id long, score double, x double").withColumns({"z": F.lit(0.0), "y": F.lit(0.0)})
    assert sorted(r.id for r in bridges.suppressed(seeds, 2.0).collect()) == [1, 3, 5]
    edges = spark.createDataFrame([(1, 2, -0.9), (2, 3, 0.8), (1, 3, 0.1), (3, 4, -0.6), (7, 8, 0.2)], "a long, b long, conormal double")
    assert {r.id: r.sign for r in bridges.signs(edges).collect()} == {1: 1, 2: -1, 3: -1, 4: 1}


def test_triangle_shapes(spark):
    point = "struct<z double, y double, x double>"
    rows = [((0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 3**0.5 / 2, 0.5)), ((0.0, 0.0, 0.0), (0.0, 0.0, 3.0), (0.0, 4.0, 0.0)), ((1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 2.0))]
    got = marching.triangle_shapes(spark.createDataFrame(rows, f"a {point}, b {point}, c {point}")).collect()
    assert (got[0].area, got[0].aspect, got[0].angle) == pytest.approx((3**0.5 / 4, 1, 60))
    assert (got[1].area, got[1].angle) == pytest.approx((6, math.degrees(math.atan2(3, 4))))
    assert (got[2].area, got[2].aspect) == (0, 0)
