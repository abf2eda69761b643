"""Iso-surfaces of sparse volumes by tetrahedra, and quality of the triangles of surface grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["z", "y", "x"]
#: The eight corners of a cell, number 4 z + 2 y + x, and the six tetrahedra around the diagonal from 0 to 7: one for
#: each order in which the three axes are walked.
CORNERS = [(k >> 2 & 1, k >> 1 & 1, k & 1) for k in range(8)]
TETRAHEDRA = [(0, a, a | b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


def _between(p: Column, q: Column, level: float) -> Column:
    """Where the value crosses ``level`` on the way from p to q."""
    t = (level - p["v"]) / (q["v"] - p["v"])
    return F.struct(*((p[a] + t * (q[a] - p[a])).alias(a) for a in KEY))


def sections(vox: DataFrame, level: float) -> DataFrame:
    """(z, y, x, tet, ring): for each tetrahedron that the surface cuts, its three or four crossings, in order around it.

    A cell is handled where all its eight corners are present; corners meet by one grouped exchange.
    """
    steps = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(d).alias(f"d{a}") for a, d in zip(KEY, c, strict=True))) for k, c in enumerate(CORNERS)))
    dealt = vox.select(*KEY, F.col("v").cast("double").alias("v")).withColumn("_c", F.explode(steps))
    corner = F.struct(F.col("_c.k").alias("k"), F.col("v"), *(F.col(a).cast("double").alias(a) for a in KEY))
    cells = dealt.select(*((F.col(a) - F.col(f"_c.d{a}")).alias(f"c{a}") for a in KEY), corner.alias("p")).groupBy(*(f"c{a}" for a in KEY)).agg(F.sort_array(F.collect_list("p")).alias("p"))
    cut = cells.filter((F.size("p") == 8) & F.exists("p", lambda c: c["v"] >= level) & F.exists("p", lambda c: c["v"] < level))
    tets = F.array(*(F.struct(F.lit(n).alias("tet"), F.array(*(F.col("p")[k] for k in tet)).alias("c")) for n, tet in enumerate(TETRAHEDRA)))
    each = cut.select(*(F.col(f"c{a}").alias(a) for a in KEY), F.explode(tets).alias("t")).select(*KEY, "t.tet", F.col("t.c").alias("c"))
    sides = each.select(*KEY, "tet", F.filter("c", lambda p: p["v"] >= level).alias("i"), F.filter("c", lambda p: p["v"] < level).alias("o")).filter((F.size("i") > 0) & (F.size("o") > 0))
    i, o = F.col("i"), F.col("o")
    lone = F.transform("o", lambda q: _between(i[0], q, level))
    other = F.transform("i", lambda p: _between(p, o[0], level))
    quad = F.array(*(_between(i[a], o[b], level) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))))
    return sides.select(*KEY, "tet", F.when(F.size("i") == 1, lone).when(F.size("o") == 1, other).otherwise(quad).alias("ring"))


def triangles(rings: DataFrame) -> DataFrame:
    """(z, y, x, tet, a, b, c): the triangles of sections; a ring of four is two."""
    ring = F.col("ring")
    one, two = (F.struct(ring[0].alias("a"), ring[k].alias("b"), ring[k + 1].alias("c")) for k in (1, 2))
    return rings.select(*KEY, "tet", F.explode(F.when(F.size("ring") == 4, F.array(one, two)).otherwise(F.array(one))).alias("t")).select(*KEY, "tet", "t.*")


def grid_triangles(cells: DataFrame) -> DataFrame:
    """(mesh, u, v, half, a, b, c as structs of z, y, x): two triangles of every whole grid square of (mesh, u, v, z, y, x)."""
    out = cells.select("mesh", "u", "v", F.struct(*KEY).alias("p00"))
    for name, du, dv in (("p10", 1, 0), ("p01", 0, 1), ("p11", 1, 1)):
        out = out.join(cells.select("mesh", (F.col("u") - du).alias("u"), (F.col("v") - dv).alias("v"), F.struct(*KEY).alias(name)), ["mesh", "u", "v"])
    halves = [F.struct(F.lit(k).alias("half"), *(F.col(p).alias(n) for n, p in zip("abc", corners, strict=True))) for k, corners in enumerate((("p00", "p10", "p01"), ("p11", "p01", "p10")))]
    return out.select("mesh", "u", "v", F.explode(F.array(*halves)).alias("t")).select("mesh", "u", "v", "t.*")


def triangle_shapes(tris: DataFrame) -> DataFrame:
    """Adds ``area``, ``aspect`` (4 sqrt 3 area over the sum of squared sides: 1 if equilateral) and ``angle``, the least, in degrees."""
    side2 = [sum(((F.col(f"{p}.{a}") - F.col(f"{q}.{a}")) * (F.col(f"{p}.{a}") - F.col(f"{q}.{a}")) for a in KEY), F.lit(0.0)) for p, q in (("b", "c"), ("c", "a"), ("a", "b"))]
    out = tris.select("*", *(s.alias(f"_{k}") for k, s in enumerate(side2)))
    total = F.col("_0") + F.col("_1") + F.col("_2")
    # sixteen times the squared area, from squared sides
    area16 = F.greatest(2 * (F.col("_0") * F.col("_1") + F.col("_1") * F.col("_2") + F.col("_2") * F.col("_0")) - F.col("_0") * F.col("_0") - F.col("_1") * F.col("_1") - F.col("_2") * F.col("_2"), F.lit(0.0))
    short, (p, q) = F.least("_0", "_1", "_2"), ((F.greatest("_0", "_1", "_2")), total - F.least("_0", "_1", "_2") - F.greatest("_0", "_1", "_2"))
    cosine = F.when(p * q > 0, (p + q - short) / (2 * F.sqrt(p * q))).otherwise(1.0)
    out = out.withColumns({"area": F.sqrt(area16) / 4, "aspect": F.when(total > 0, 3**0.5 * F.sqrt(area16) / total).otherwise(0.0), "angle": F.degrees(F.acos(F.least(cosine, F.lit(1.0))))})
    return out.drop("_0", "_1", "_2")


def shape_quality(tris: DataFrame, aspect: float = 0.08, angle: float = 20.0) -> DataFrame:
    """(mesh, n, area, slivers, sharp): triangles, their area, and the shares with a small aspect or a small angle."""
    shapes = triangle_shapes(tris)
    return shapes.groupBy("mesh").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.avg((F.col("aspect") < aspect).cast("double")).alias("slivers"), F.avg((F.col("angle") < angle).cast("double")).alias("sharp"))
