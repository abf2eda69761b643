"""Analytic volumes with known answers."""

import pytest
from pyspark.sql import functions as F

from laminae.functions import numeric
from laminae.operators import graph, metrics, stencil, voxel, winding


def cube(spark, n):
    return spark.range(n**3).select(F.floor(F.col("id") / (n * n)).alias("z"), (F.floor(F.col("id") / n) % n).alias("y"), (F.col("id") % n).alias("x"), "id")


def ball(spark, n, centre, r2, low=0):
    d = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip(("z", "y", "x"), centre)), F.lit(0))
    return cube(spark, n).filter((d <= r2) & (d >= low)).select("z", "y", "x")


def test_dice_of_shifted_runs(spark):
    vox = cube(spark, 8)
    row = metrics.overlap(vox.filter("id < 100"), vox.filter("id >= 50 and id < 150")).first()
    assert row.dice == 0.5 and row.iou == pytest.approx(1 / 3)
    same = metrics.overlap(vox.filter("id < 0"), vox.filter("id < 0")).first()
    assert same.dice == 1 and same.iou == 1


def test_partition_scores(spark):
    vox = cube(spark, 8).select("z", "y", "x", (1 + F.floor(F.col("id") / 64)).alias("s"))
    one = metrics.variation_of_information(vox.select("s", F.lit(1).alias("g"))).first()
    assert one["split"] > 0.1 and one["merge"] == pytest.approx(0) or one["merge"] > 0.1 and one["split"] == pytest.approx(0)
    same = metrics.variation_of_information(vox.select("s", F.col("s").alias("g"))).first()
    assert same["split"] == pytest.approx(0) and same["merge"] == pytest.approx(0)
    empty = metrics.variation_of_information(vox.filter("s < 0").select("s", F.col("s").alias("g"))).first()
    assert (empty["split"], empty["merge"]) == (0, 0)


def test_ball_topology(spark):
    assert tuple(graph.betti(ball(spark, 16, (8, 8, 8), 25), (16, 16, 16)).first()) == (1, 0, 0, 1)


def test_shell_topology(spark):
    assert tuple(graph.betti(ball(spark, 16, (8, 8, 8), 36, 16), (16, 16, 16)).first()) == (1, 0, 1, 2)


def test_diagonal_voxels(spark):
    mask = spark.createDataFrame([(2, 2, 2), (3, 3, 3)], "z long, y long, x long")
    assert graph.voxel_components(mask, (8, 8, 8)).select("label").distinct().count() == 2
    assert graph.voxel_components(mask, (8, 8, 8), full=True).select("label").distinct().count() == 1


def test_long_chain_is_one_component(spark):
    mask = spark.range(300).select(F.lit(0).cast("long").alias("z"), F.lit(0).cast("long").alias("y"), F.col("id").alias("x"))
    assert graph.voxel_components(mask, (1, 1, 300)).select("label").distinct().collect()[0].label == 0


def test_empty_mask(spark):
    none = spark.createDataFrame([], "z long, y long, x long")
    assert graph.voxel_components(none, (4, 4, 4)).count() == 0
    assert stencil.dilate(none, stencil.FACES, (4, 4, 4)).count() == 0
    assert stencil.euler(none).first().chi == 0


def test_min_max_range(spark):
    vox = cube(spark, 4).withColumn("v", F.col("id") + 10)
    row = voxel.min_max(vox).agg(F.min("v"), F.max("v")).first()
    assert tuple(row) == (0, 1)
    flat = voxel.min_max(cube(spark, 2).withColumn("v", F.lit(3))).agg(F.max("v")).first()
    assert flat[0] == 0


def test_percentile_outlier(spark):
    vox = cube(spark, 10).withColumn("v", F.when(F.col("id") == 500, 1000.0).otherwise(0.5))
    assert voxel.percentile_normalize(vox).agg(F.max("v")).first()[0] <= 1


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert df.agg(numeric.upper_median("v")).first()[0] == 3.0


def test_polar_voxel(spark):
    r, t = numeric.polar(F.lit(0.0), F.lit(4.0))
    assert tuple(spark.range(1).select(r, t).first()) == (4.0, 0.0)


def test_spiral_fit_recovers_line(spark):
    rows = spark.range(200).select((F.col("id") / 40.0 - 2.5).alias("t")).select((5 + 0.5 * F.col("t")).alias("r"), "t")
    vox = rows.select(F.lit(0).alias("z"), (F.col("r") * F.sin("t")).alias("y"), (F.col("r") * F.cos("t")).alias("x"))
    row = winding.spiral_fit(vox, 0.0, 0.0).first()
    assert row.a == pytest.approx(5, abs=1e-6) and row.b == pytest.approx(0.5, abs=1e-6) and row.rms < 1e-4
