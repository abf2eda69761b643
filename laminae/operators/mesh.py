"""Surface quality over uv grids: tables (mesh, u, v, z, y, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.functions.numeric import upper_median

AT = ["z", "y", "x"]


def edges(cells: DataFrame) -> DataFrame:
    """(mesh, length) between valid neighbours along u and along v."""
    steps = F.array(F.struct(F.lit(1).alias("du"), F.lit(0).alias("dv")), F.struct(F.lit(0).alias("du"), F.lit(1).alias("dv")))
    here = cells.withColumn("_s", F.explode(steps)).select("mesh", (F.col("u") + F.col("_s.du")).alias("u"), (F.col("v") + F.col("_s.dv")).alias("v"), *(F.col(a).alias(f"from_{a}") for a in AT))
    d2 = sum(((F.col(a) - F.col(f"from_{a}")) * (F.col(a) - F.col(f"from_{a}")) for a in AT), F.lit(0.0))
    return here.join(cells.select("mesh", "u", "v", *AT), ["mesh", "u", "v"]).select("mesh", F.sqrt(d2).alias("length"))


def edge_stats(cells: DataFrame) -> DataFrame:
    """(mesh, n, mean, sd, median, long): population deviation, upper median, share of edges over twice the mean."""
    e = edges(cells)
    stats = e.groupBy("mesh").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("sd"), upper_median("length").alias("median"))
    long = e.join(stats.select("mesh", "mean"), "mesh").groupBy("mesh").agg(F.avg((F.col("length") > 2 * F.col("mean")).cast("double")).alias("long"))
    return stats.join(long, "mesh")


def self_intersections(cells: DataFrame, cell: float, apart: int = 6) -> DataFrame:
    """(mesh, n): cells in a bin whose first cell, in (v, u) order, lies more than ``apart`` steps away on the grid."""
    binned = cells.select("mesh", "u", "v", *(F.floor(F.col(a) / cell).alias(f"b{a}") for a in AT))
    keys = ["mesh", *(f"b{a}" for a in AT)]
    first = binned.groupBy(*keys).agg(F.min(F.struct("v", "u")).alias("first"))
    far = F.abs(F.col("u") - F.col("first.u")) + F.abs(F.col("v") - F.col("first.v")) > apart
    return binned.join(first, keys).groupBy("mesh").agg(F.sum(far.cast("bigint")).alias("n"))


def grid_normals(cells: DataFrame) -> DataFrame:
    """(mesh, u, v, nz, ny, nx): unit cross product of central differences; cells without all four neighbours drop."""
    out = cells.select("mesh", "u", "v")
    for name, du, dv in (("right", 1, 0), ("left", -1, 0), ("down", 0, 1), ("up", 0, -1)):
        side = cells.select("mesh", (F.col("u") - du).alias("u"), (F.col("v") - dv).alias("v"), *(F.col(a).alias(f"{name}_{a}") for a in AT))
        out = out.join(side, ["mesh", "u", "v"])
    a, b = ([F.col(f"{p}_{c}") - F.col(f"{q}_{c}") for c in AT] for p, q in (("right", "left"), ("down", "up")))
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    norm = F.sqrt(sum((c * c for c in cross), F.lit(0.0)))
    return out.select("mesh", "u", "v", *(F.when(norm > 0, c / norm).otherwise(0.0).alias(f"n{n}") for c, n in zip(cross, AT, strict=True)))


def profiles(cells: DataFrame, vox: DataFrame, offsets: list[float]) -> DataFrame:
    """(mesh, u, v, t, value): nearest voxel at offsets along each cell's normal; missing ones are 0."""
    steps = F.explode(F.array(*(F.lit(float(t)) for t in offsets)))
    dealt = cells.withColumn("t", steps)
    at = [F.round(F.col(a) + F.col("t") * F.col(f"n{a}")).cast("bigint").alias(f"_{a}") for a in AT]
    grey = vox.select(*(F.col(a).alias(f"_{a}") for a in AT), F.col("v").alias("value"))
    return dealt.select("mesh", "u", "v", "t", *at).join(grey, [f"_{a}" for a in AT], "left").select("mesh", "u", "v", "t", F.coalesce("value", F.lit(0)).alias("value"))


def brightness_delta(profile: DataFrame) -> DataFrame:
    """(mesh, n, delta): mean of the value on the surface less the mean of those off it."""
    on, off = F.avg(F.when(F.col("t") == 0, F.col("value"))), F.avg(F.when(F.col("t") != 0, F.col("value")))
    per = profile.groupBy("mesh", "u", "v").agg((on - off).alias("d"))
    return per.groupBy("mesh").agg(F.count("*").alias("n"), F.avg("d").alias("delta"))


def valley_count(profile: DataFrame, keys: list[str], order: str, value: str, prominence: float) -> DataFrame:
    """(keys, valleys): falls and rises by ``prominence`` along each profile, by a fold over its ordered values."""
    lists = profile.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("values"))
    start = F.struct(F.element_at("values", 1).alias("top"), F.element_at("values", 1).alias("low"), F.lit(False).alias("fell"), F.lit(0).alias("n"))

    def step(s, v):
        rise = s["fell"] & (v - s["low"] >= prominence)
        fall = ~s["fell"] & (s["top"] - v >= prominence)
        top = F.when(rise, v).otherwise(F.when(s["fell"], s["top"]).otherwise(F.greatest(s["top"], v)))
        low = F.when(fall, v).otherwise(F.when(s["fell"], F.least(s["low"], v)).otherwise(s["low"]))
        fell = F.when(rise, F.lit(False)).otherwise(s["fell"] | fall)
        return F.struct(top.alias("top"), low.alias("low"), fell.alias("fell"), (s["n"] + rise.cast("int")).alias("n"))

    return lists.select(*keys, F.aggregate("values", start, step)["n"].alias("valleys"))


def triangle_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh, vertex, nz, ny, nx): area-weighted sums of the normals of each vertex's triangles (mesh, a, b, c)."""
    out = triangles.withColumn("_t", F.monotonically_increasing_id())
    for k in ("a", "b", "c"):
        out = out.join(vertices.select("mesh", F.col("vertex").alias(k), *(F.col(x).alias(f"{k}{x}") for x in AT)), ["mesh", k])
    p, q = ([F.col(f"{k}{x}") - F.col(f"a{x}") for x in AT] for k in ("b", "c"))
    cross = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    each = out.select("mesh", F.explode(F.array("a", "b", "c")).alias("vertex"), *(c.alias(f"n{x}") for c, x in zip(cross, AT, strict=True)))
    return each.groupBy("mesh", "vertex").agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in AT))


def orientation(points: DataFrame, limit: float, least: int) -> DataFrame:
    """(mesh, n, consistency): share of a mesh's normals on the commoner side of the radial direction.

    Normals nearly across it, with a cosine up to ``limit``, do not count; nor do meshes of fewer than ``least`` others.
    """
    dot, r2, n2 = (sum((F.col(f"{a}{x}") * F.col(f"{b}{x}") for x in AT), F.lit(0.0)) for a, b in (("", "n"), ("", ""), ("n", "n")))
    clear = points.select("mesh", (dot / F.sqrt(r2 * n2)).alias("d")).filter(F.abs("d") > limit)
    share = F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0))
    return clear.groupBy("mesh").agg(F.count("*").alias("n"), F.greatest(share, 1 - share).alias("consistency")).filter(F.col("n") >= least)


def summary(points: DataFrame) -> DataFrame:
    """(mesh, n, z0, z1, ..., peak): points of a mesh, the ends of its box, and the sum of its squared normals."""
    ends = [f(a).alias(f"{a}{k}") for a in AT for k, f in enumerate((F.min, F.max))]
    return points.groupBy("mesh").agg(F.count("*").alias("n"), *ends, F.sum(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AT), F.lit(0.0))).alias("peak"))
