"""Ordered operators: carries, smoothing, sessions, first owners, profiles, samplers and registries."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminae.session import settled


def centroids(vox: DataFrame, t: float) -> DataFrame:
    """(z, cy, cx): mean position of voxels with v >= t in each slice; null where a slice has none."""
    hit = F.col("v") >= t
    return vox.groupBy("z").agg(F.avg(F.when(hit, F.col("y"))).alias("cy"), F.avg(F.when(hit, F.col("x"))).alias("cx"))


def carry_forward(rows: DataFrame, order: str, columns: list[str], initial: list[float], by: list[str] | None = None) -> DataFrame:
    """Nulls take the last value before them, or the initial one."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*(c for c in rows.columns if c not in columns), *(F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(v)).alias(c) for c, v in zip(columns, initial, strict=True)))


def smooth_inner(rows: DataFrame, order: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of three neighbours; the end points stay."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    ends = F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()
    return rows.select(*(c for c in rows.columns if c not in columns), *(F.when(ends, F.col(c)).otherwise(F.avg(c).over(w.rowsBetween(-1, 1))).alias(c) for c in columns))


def smooth_replicated(rows: DataFrame, order: str, column: str, by: list[str]) -> DataFrame:
    """Mean of three neighbours; the ends repeat their own value."""
    w = Window.partitionBy(*by).orderBy(order)
    mean = (F.coalesce(F.lag(column).over(w), F.col(column)) + F.col(column) + F.coalesce(F.lead(column).over(w), F.col(column))) / 3.0
    return rows.withColumn(column, mean)


def islands(rows: DataFrame, by: str, order: str, gap: float) -> DataFrame:
    """Adds ``island``: consecutive rows of a key whose gap to the one before is below ``gap``."""
    w = Window.partitionBy(by).orderBy(order, *(c for c in rows.columns if c not in (by, order)))
    new = F.coalesce((F.col(order) - F.lag(order).over(w) >= gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_owner(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    best = rows.groupBy(*key).agg(F.min(F.struct(order, *(c for c in rows.columns if c not in (*key, order)))).alias("m"))
    return best.select(*key, "m.*")


def radial_profile(vox: DataFrame, cy: float, cx: float, sectors: int, slab: int) -> DataFrame:
    """(slab, sector, r, n, mean) of positive voxels about an axis; radii round to the nearest."""
    import math

    dy, dx = F.col("y") - cy, F.col("x") - cx
    sector = F.least(((F.atan2(dy, dx) + math.pi) * sectors / (2 * math.pi)).cast("bigint"), F.lit(sectors - 1))
    keyed = vox.filter("v > 0").select(F.floor(F.col("z") / slab).alias("slab"), sector.alias("sector"), (F.hypot(dy, dx) + 0.5).cast("bigint").alias("r"), "v")
    return keyed.groupBy("slab", "sector", "r").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def high_pass(profile: DataFrame, half: int, least: int, count: int) -> DataFrame:
    """Adds ``ripple``: a bin's mean less that of bins within ``half`` radii, all with ``count`` voxels at least."""
    valid = profile.filter(F.col("n") >= count)
    w = Window.partitionBy("slab", "sector").orderBy("r").rangeBetween(-half, half)
    near = valid.select("*", F.avg("mean").over(w).alias("_m"), F.count("*").over(w).alias("_k"))
    return near.filter(F.col("_k") >= least).select("slab", "sector", "r", (F.col("mean") - F.col("_m")).alias("ripple"))


def sector_votes(ripples: DataFrame, least: int, dissent: int) -> DataFrame:
    """(slab, r, amplitude): median ripple of radii whose sectors agree in sign."""
    up, down = (F.sum((op).cast("int")) for op in (F.col("ripple") > 0, F.col("ripple") < 0))
    votes = ripples.groupBy("slab", "r").agg(F.count("*").alias("k"), F.least(up, down).alias("against"), F.percentile("ripple", F.lit(0.5)).alias("amplitude"))
    return votes.filter((F.col("k") >= least) & (F.col("against") <= dissent)).select("slab", "r", "amplitude")


def subtract_rings(vox: DataFrame, rings: DataFrame, cy: float, cx: float, slab: int) -> DataFrame:
    """v less its ring's amplitude, not below 0; voxels at or below 0 stay."""
    keyed = vox.select("*", F.floor(F.col("z") / slab).alias("slab"), (F.hypot(F.col("y") - cy, F.col("x") - cx) + 0.5).cast("bigint").alias("r"))
    out = keyed.join(rings, ["slab", "r"], "left")
    return out.select("z", "y", "x", F.when(F.col("v") <= 0, F.col("v").cast("double")).otherwise(F.greatest(F.col("v") - F.coalesce("amplitude", F.lit(0.0)), F.lit(0.0))).alias("v"))


def cumulative_sampler(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """For draws (draw, u in [0, 1)): the item (id, w) whose cumulative weight first exceeds u of the total.

    Sums run inside ranges of ids, from the totals of the ranges before; draws and items meet by buckets of the share.
    """
    part = settled(weights.select("id", "w").repartitionByRange("id").withColumn("_part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in part.groupBy("_part").agg(F.sum("w"), F.count("*")).collect())
    if not sums:
        return draws.limit(0).crossJoin(part.select("id")).select("draw", "id")
    before = list(accumulate((w for _, w, _ in sums), initial=0))
    buckets = sum(n for _, _, n in sums)
    starts = weights.sparkSession.createDataFrame([(p, b) for (p, _, _), b in zip(sums, before, strict=False)], "_part int, _before " + part.groupBy().agg(F.sum("w")).schema[0].dataType.simpleString())
    upto = F.sum("w").over(Window.partitionBy("_part").orderBy("id")) + F.col("_before")
    cut = part.join(F.broadcast(starts), "_part").select("id", "w", upto.alias("_sum")).select("id", (F.col("_sum") / before[-1]).alias("upto"), ((F.col("_sum") - F.col("w")) / before[-1]).alias("since"))
    bucket = lambda share: F.floor(share * buckets)
    spread = cut.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.col("upto")))))
    met = draws.withColumn("_bucket", bucket(F.col("u"))).join(spread, "_bucket")
    return met.filter((F.col("u") >= F.col("since")) & (F.col("u") < F.col("upto"))).select("draw", "id")


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that the ledger does not have yet."""
    return work.join(done, key, "left_anti")


def registry_union(key: str, **tables: DataFrame) -> DataFrame:
    """Full outer join of keyed registries: which of them know a key, and their columns."""
    out = None
    for name, table in tables.items():
        marked = table.withColumn(f"in_{name}", F.lit(True))
        out = marked if out is None else out.join(marked, key, "full_outer")
    return out.select(*(F.coalesce(F.col(c), F.lit(False)).alias(c) if c.startswith("in_") else F.col(c) for c in out.columns))


def repeat_suspects(runs: DataFrame, item: str, run: str, least: int = 2) -> DataFrame:
    """Items that several runs suspect."""
    return runs.groupBy(item).agg(F.countDistinct(run).alias("runs"), F.sum("loss").alias("loss")).filter(F.col("runs") >= least)


def steps(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``step``: the value less that of the row before in its series; null at the first."""
    return rows.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
