"""Corpus-level operators: separation of surfaces, fields on meshes, crops, selections and augmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["z", "y", "x"]


def separation(a: DataFrame, b: DataFrame, bins: list[str], least: int) -> DataFrame:
    """One row (bins, median): over bins that both have, each point of a to the nearest radius of b; the linear median.

    The nearest radius on either side comes from one ordered window over both sides, not from pairs.
    """
    both = a.select(*bins, "r", F.lit(0).alias("side")).union(b.select(*bins, "r", F.lit(1).alias("side")))
    order = Window.partitionBy(*bins).orderBy("r", "side")
    other = F.when(F.col("side") == 1, F.col("r"))
    before = F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(other, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("r") - before, after - F.col("r"))
    per = both.withColumn("gap", gap).filter("side = 0 and gap is not null").groupBy(*bins).agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    return per.agg(F.count("*").alias("bins"), F.percentile("gap", F.lit(0.5)).alias("median")).filter(F.col("bins") >= least)


def fold_fraction(field: DataFrame) -> DataFrame:
    """One row (n, folds): interior voxels, and those where det(I + grad d) <= 0.001, of a displacement (dz, dy, dx)."""
    # each voxel goes to the six that look at it: one grouping, no chain of joins
    looks = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(step).alias("step")) for a in KEY for step in (1, -1)))
    dealt = field.withColumn("_o", F.explode(looks))
    moved = dealt.select(*((F.col(a) - F.when(F.col("_o.axis") == a, F.col("_o.step")).otherwise(0)).alias(a) for a in KEY), "_o", *(F.col(f"d{a}").alias(f"d{a}") for a in KEY))
    sides = [F.max(F.when((F.col("_o.axis") == j) & (F.col("_o.step") == step), F.col(f"d{i}"))).alias(f"{name}_{j}_{i}") for j in KEY for i in KEY for step, name in ((1, "next"), (-1, "last"))]
    out = moved.groupBy(*KEY).agg(F.count("*").alias("k"), *sides).filter("k = 6").join(field.select(*KEY), KEY, "left_semi")
    g = {(i, j): (F.col(f"next_{j}_{i}") - F.col(f"last_{j}_{i}")) / 2.0 + (1.0 if i == j else 0.0) for i in KEY for j in KEY}
    z, y, x = KEY
    det = g[z, z] * (g[y, y] * g[x, x] - g[y, x] * g[x, y]) - g[z, y] * (g[y, z] * g[x, x] - g[y, x] * g[x, z]) + g[z, x] * (g[y, z] * g[x, y] - g[y, y] * g[x, z])
    return out.select(det.alias("det")).agg(F.count("*").alias("n"), F.sum((F.col("det") <= 0.001).cast("bigint")).alias("folds"))


def crop_summary(crops: DataFrame, by: str) -> DataFrame:
    """(by, n, median, good): linear median and share of at least 70 of measured crops; -1 means unmeasured."""
    measured = F.when(F.col("ridge") >= 0, F.col("ridge"))
    return crops.groupBy(by).agg(F.count(measured).alias("n"), F.percentile(measured, F.lit(0.5)).alias("median"), F.avg((measured >= 70).cast("double")).alias("good"))


def tri_state(sheet: DataFrame, around: DataFrame, labelled: DataFrame) -> DataFrame:
    """(z, y, x, label): 255 on the sheet, 128 trusted background around it where labelled, else 0."""
    marks = sheet.select(*KEY, F.lit(255).alias("m")).union(around.select(*KEY, F.lit(128)))
    best = marks.groupBy(*KEY).agg(F.max("m").alias("m"))
    return labelled.select(*KEY).join(best, KEY, "left").select(*KEY, F.coalesce("m", F.lit(0)).alias("label"))


def octahedral(vox: DataFrame, order: tuple[int, int, int], flips: tuple[bool, bool, bool], shape: tuple[int, int, int]) -> DataFrame:
    """Axes permuted, then flipped: one of the 48 symmetries, by coordinates alone."""
    moved = []
    for axis, source, flip in zip(KEY, order, flips, strict=True):
        at = F.col(KEY[source])
        moved.append(((shape[source] - 1 - at) if flip else at).alias(axis))
    return vox.select(*moved, "v")


def first_crossings(wound: DataFrame, level: float) -> DataFrame:
    """(z, y, x): where the winding first reaches ``level`` along each row, between two voxels by linear share."""
    row = Window.partitionBy("z", "y").orderBy("x")
    steps = wound.select("z", "y", "x", "w", F.lag("w").over(row).alias("before"), F.lag("x").over(row).alias("from"))
    hits = steps.filter((F.col("before") < level) & (F.col("w") >= level))
    at = F.col("from") + (level - F.col("before")) / (F.col("w") - F.col("before")) * (F.col("x") - F.col("from"))
    return hits.withColumn("at", at).groupBy("z", "y").agg(F.min("at").alias("x"))


def snapped(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, value): the brightest offset of each profile; of equal ones the first."""
    best = profile.groupBy(*keys).agg(F.min(F.struct((-F.col("value")).alias("low"), "t", "value")).alias("m"))
    return best.select(*keys, "m.t", "m.value")


def field_windings(cells: DataFrame, by: str) -> DataFrame:
    """(by, winding, spread): whole winding of a patch from its cells' field, by the circular mean of the fraction."""
    angle = 2 * math.pi * F.col("w")
    means = cells.groupBy(by).agg(F.avg("w").alias("mean"), F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    share = F.atan2("s", "c") / (2 * math.pi)
    return means.select(by, F.round(F.col("mean") - share).cast("bigint").alias("winding"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("s") * F.col("s") - F.col("c") * F.col("c"))).alias("spread"))


def emitted(blocks: DataFrame, offsets: DataFrame, anchor: float) -> DataFrame:
    """(block, wrap, n): voxels of each wrap after the block's offset; the phase rounds up from one half."""
    w = F.col("rel") + F.col("off") + anchor
    whole = F.floor(w)
    return blocks.join(offsets, "block").select("block", (whole + (w - whole >= 0.5).cast("int")).cast("bigint").alias("wrap")).groupBy("block", "wrap").agg(F.count("*").alias("n"))


def union_per_volume(meshes: DataFrame) -> DataFrame:
    """(volume, meshes): distinct meshes of each volume, sorted."""
    return meshes.groupBy("volume").agg(F.sort_array(F.collect_set("mesh")).alias("meshes"))


def finest_present(levels: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """(z, y, x, lod, v): the finest level that has a value for each wanted voxel."""
    out = wanted.select(*KEY)
    for k in range(depth):
        level = levels.filter(F.col("lod") == k).select(*(F.col(a).alias(f"_{a}") for a in KEY), F.col("v").alias(f"v{k}"))
        same = [F.floor(F.col(a) / (1 << k)) == F.col(f"_{a}") for a in KEY]
        out = out.join(level, same, "left").drop(*(f"_{a}" for a in KEY))
    lod = F.coalesce(*(F.when(F.col(f"v{k}").isNotNull(), F.lit(k)) for k in range(depth)))
    return out.select(*KEY, lod.alias("lod"), F.coalesce(*(F.col(f"v{k}") for k in range(depth))).alias("v"))


def trusted(cells: DataFrame, grid: DataFrame, tile: int) -> DataFrame:
    """Cells whose tile isn't failed; a tile without a verdict passes."""
    keyed = cells.withColumn("tu", F.floor(F.col("u") / tile)).withColumn("tv", F.floor(F.col("v") / tile))
    return keyed.join(grid.filter("verdict = 'F'"), ["tu", "tv"], "left_anti").drop("tu", "tv")


def band_axis(rays: DataFrame, width: float, least: int) -> DataFrame:
    """(band, cy, cx): least-squares meeting point of rays (z, y, x, ny, nx) by z band, from 2 x 2 normal equations."""
    norm = F.hypot("ny", "nx")
    unit = rays.filter(norm >= 0.5).select(F.floor(F.col("z") / width).alias("band"), "y", "x", (F.col("ny") / norm).alias("a"), (F.col("nx") / norm).alias("b"))
    pyy, pxx, pyx = 1 - F.col("a") * F.col("a"), 1 - F.col("b") * F.col("b"), -F.col("a") * F.col("b")
    sums = unit.groupBy("band").agg(F.count("*").alias("n"), F.sum(pyy).alias("yy"), F.sum(pxx).alias("xx"), F.sum(pyx).alias("yx"), F.sum(pyy * F.col("y") + pyx * F.col("x")).alias("ry"), F.sum(pyx * F.col("y") + pxx * F.col("x")).alias("rx"))
    det = F.col("yy") * F.col("xx") - F.col("yx") * F.col("yx")
    solved = sums.filter((F.col("n") >= least) & (F.abs(det) > 1e-9))
    return solved.select("band", ((F.col("xx") * F.col("ry") - F.col("yx") * F.col("rx")) / det).alias("cy"), ((F.col("yy") * F.col("rx") - F.col("yx") * F.col("ry")) / det).alias("cx"))
