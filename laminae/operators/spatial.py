"""Spatial joins: boxes, nearest points, axis look-ups and interpolation, all as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminae.session import settled

KEY = ["z", "y", "x"]


def boxes(cells: DataFrame, by: str = "mesh") -> DataFrame:
    """(mesh, lo_z .. hi_x): bounding box of each mesh's cells."""
    return cells.groupBy(by).agg(*(f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in KEY))


def overlapping(boxes_df: DataFrame, margin: float, cell: float, by: str = "mesh") -> DataFrame:
    """(a, b), a < b: boxes that meet within ``margin``.

    Boxes are dealt to the grid cells that they touch; a pair is kept only in the cell of its overlap's low corner, so
    it appears once without a distinct.
    """
    dealt = boxes_df
    for a in KEY:
        lo, hi = F.floor((F.col(f"lo_{a}") - margin) / cell), F.floor((F.col(f"hi_{a}") + margin) / cell)
        dealt = dealt.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    cells = [f"c{a}" for a in KEY]
    one, two = (dealt.select(*cells, F.col(by).alias(n), *(F.col(f"{e}_{a}").alias(f"{n}_{e}_{a}") for e in ("lo", "hi") for a in KEY)) for n in ("a", "b"))
    pairs = one.join(two, cells).filter("a < b")
    for a in KEY:
        pairs = pairs.filter((F.col(f"a_lo_{a}") - margin <= F.col(f"b_hi_{a}")) & (F.col(f"b_lo_{a}") - margin <= F.col(f"a_hi_{a}")))
        corner = F.floor((F.greatest(f"a_lo_{a}", f"b_lo_{a}") - margin) / cell)
        pairs = pairs.filter(F.col(f"c{a}") == corner)
    return pairs.select("a", "b")


def in_box(boxes_df: DataFrame, low, high, by: str = "mesh") -> DataFrame:
    """Meshes whose box meets the given one."""
    for a, lo, hi in zip(KEY, low, high, strict=True):
        boxes_df = boxes_df.filter((F.col(f"lo_{a}") <= hi) & (F.col(f"hi_{a}") >= lo))
    return boxes_df.select(by)


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` (id, z, y, x) and ``right`` (id, ...) within ``radius``: (id, other, d2).

    Points are binned by ``radius``; the right side is dealt to the 27 bins around each point, so a hit is one
    equi-join away. Exact for distances up to the bin size, which is all it is asked for.
    """
    bins = [f"b{a}" for a in KEY]
    one = left.select(F.col("id"), *KEY, *(F.floor(F.col(a) / radius).alias(f"b{a}") for a in KEY))
    two = right.select(F.col("id").alias("other"), *(F.col(a).alias(f"o{a}") for a in KEY), *(F.floor(F.col(a) / radius).alias(f"b{a}") for a in KEY))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    for b in bins:
        two = two.withColumn("_s", step).withColumn(b, F.col(b) + F.col("_s")).drop("_s")
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in KEY), F.lit(0.0))
    return one.join(two, bins).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select("id", "other", "d2")


def recall_at(truth: DataFrame, found: DataFrame, radius: float) -> DataFrame:
    """One row (n, hits): points of ``truth`` with a point of ``found`` within ``radius``."""
    hits = near_pairs(truth, found, radius).select("id").distinct().agg(F.count("*").alias("hits"))
    return truth.agg(F.count("*").alias("n")).crossJoin(hits)


def nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(id, other, d2): nearest point of ``right`` within ``radius``; ties go to the least other."""
    pairs = near_pairs(left, right, radius)
    best = pairs.groupBy("id").agg(F.min(F.struct("d2", "other")).alias("m"))
    return best.select("id", F.col("m.other").alias("other"), F.col("m.d2").alias("d2"))


def nearest_any(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(id, other, d2): nearest point of ``right`` at any distance; without points on the right, no rows.

    Cells widen twofold for the points that found nothing, so the rounds are the logarithm of the longest distance.
    """
    left = left.select("id", *KEY)
    if right.isEmpty():
        return nearest(left, right, cell)
    found = None
    while not left.isEmpty():
        best = settled(nearest(left, right, cell))
        found = best if found is None else found.union(best)
        left = settled(left.join(best, "id", "left_anti"))
        cell *= 2
    return nearest(left, right, cell) if found is None else found


def trace_scores(truth: DataFrame, found: DataFrame, reach: float) -> DataFrame:
    """One row (n, at2, at4, mean, median): shares of points with a neighbour within 2 and 4, and the mean and upper
    median of distances, which end at ``reach``."""
    near = nearest(truth, found, reach).select("id", F.sqrt("d2").alias("d"))
    d = F.coalesce("d", F.lit(reach))
    all_ = truth.select("id").join(near, "id", "left").select(d.alias("d"))
    return all_.agg(F.count("*").alias("n"), F.avg((F.col("d") <= 2).cast("double")).alias("at2"), F.avg((F.col("d") <= 4).cast("double")).alias("at4"), F.avg("d").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)").alias("median"))


def cluster_offsets(cells: DataFrame, cluster: list[str]) -> DataFrame:
    """(a, b, clusters, offs): mean difference of two meshes' values over the clusters that both reach.

    ``cells`` are (cluster, mesh, value); a mesh counts once in a cluster, so pairs grow with meshes, not with cells.
    """
    means = cells.groupBy(*cluster, "mesh").agg(F.avg("value").alias("m"))
    one, two = (means.select(*cluster, F.col("mesh").alias(n), F.col("m").alias(f"m{n}")) for n in ("a", "b"))
    return one.join(two, cluster).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("clusters"), F.avg(F.col("mb") - F.col("ma")).alias("offs"))


def axis_segments(axis: DataFrame) -> DataFrame:
    """Control points (z, y, x) to half-open segments with their next point; the axis is small, and its last is open."""
    order = Window.orderBy("z")
    return axis.select(F.col("z").alias("z0"), F.col("y").alias("y0"), F.col("x").alias("x0"), *(F.lead(a).over(order).alias(f"{a}1") for a in KEY))


def on_axis(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Adds cy, cx: the axis at each point's z, interpolated between control points and clamped at its ends.

    Segments are dealt to cells of z about as long as a segment, so points meet theirs by the number of a cell.
    """
    ends = axis.agg(F.min("z").cast("double").alias("low"), F.max("z").cast("double").alias("high"), F.count("z").alias("n")).first()
    if not ends["n"]:
        return points.select("*", *(F.lit(None).cast("double").alias(f"c{a}") for a in ("y", "x"))).limit(0)
    cell = max((ends["high"] - ends["low"]) / ends["n"], 1e-9)
    number = lambda z: F.floor((z - ends["low"]) / cell)
    segments = axis_segments(axis).withColumn("_cell", F.explode(F.sequence(number(F.col("z0")), number(F.coalesce("z1", "z0")))))
    z = F.least(F.greatest(F.col("z").cast("double"), F.lit(ends["low"])), F.lit(ends["high"]))
    inside = (F.col("zc") >= F.col("z0")) & (F.col("z1").isNull() | (F.col("zc") < F.col("z1")))
    share = F.when(F.col("z1").isNull(), 0.0).otherwise((F.col("zc") - F.col("z0")) / (F.col("z1") - F.col("z0")))
    out = points.withColumn("zc", z).withColumn("_cell", number(F.col("zc"))).join(segments, "_cell").filter(inside)
    return out.select(*(points[c] for c in points.columns), *((F.col(f"{a}0") + share * F.coalesce(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(0.0))).alias(f"c{a}") for a in ("y", "x")))


def trilinear(points: DataFrame, vox: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(id, value): the volume at fractional points, eight clamped corners each; a missing voxel counts as 0."""
    corners = F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip(KEY, (i, j, k), strict=True))) for i in (0, 1) for j in (0, 1) for k in (0, 1)))
    dealt = points.withColumn("_c", F.explode(corners))
    weight = F.lit(1.0)
    at = []
    for a, n in zip(KEY, shape, strict=True):
        p = F.least(F.greatest(F.col(a), F.lit(0.0)), F.lit(float(n - 1)))
        low = F.floor(p)
        part = p - low
        weight = weight * F.when(F.col(f"_c.{a}") == 1, part).otherwise(1 - part)
        at.append(F.least(low + F.col(f"_c.{a}"), F.lit(n - 1)).alias(a))
    taps = dealt.select("id", *at, weight.alias("w"))
    return taps.join(vox.select(*KEY, "v"), KEY, "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("value"))


def tiles(extent: DataFrame, size: int, step: int) -> DataFrame:
    """Tile starts along n for rows (name, n): every step, the last clamped to n - size, without repeats."""
    last = F.greatest(F.col("n") - size, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), last + step - 1, F.lit(step).cast("bigint")))
    return extent.select("name", starts.alias("start"), last.alias("last")).select("name", F.least("start", "last").alias("start")).distinct()


def blend(patches: DataFrame) -> DataFrame:
    """Overlap-add of weighted patch values (z, y, x, value, weight)."""
    return patches.groupBy(*KEY).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("v"))


def stamp(samples: DataFrame, offsets, label: int) -> DataFrame:
    """Voxels within the offsets of any sample, labelled."""
    from laminae.operators.stencil import shifted

    rounded = samples.select(*(F.round(a).cast("bigint").alias(a) for a in KEY)).distinct()
    return shifted(rounded, offsets).distinct().withColumn("label", F.lit(label))
