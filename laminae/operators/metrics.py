"""Scores of predictions against truth: overlap, partitions, surfaces, ranking and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.operators.stencil import FACES, shifted
from laminae.operators.voxel import KEY
from laminae.session import running_sums


def _share(top, bottom, empty: float = 1.0):
    return F.when(bottom == 0, empty).otherwise(top / bottom)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (dice, iou, n_a, n_b, n_both) of two sparse foregrounds; both empty score 1."""
    both = a.select(*KEY, F.lit(1).alias("a")).join(b.select(*KEY, F.lit(1).alias("b")), KEY, "full_outer")
    counts = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in ((F.col("a"), "n_a"), (F.col("b"), "n_b"), (F.col("a") * F.col("b"), "n_both"))))
    return counts.select(_share(2.0 * F.col("n_both"), F.col("n_a") + F.col("n_b")).alias("dice"), _share(F.col("n_both") * 1.0, F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("iou"), "n_a", "n_b", "n_both")


def variation_of_information(pairs: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """One row (split, merge) from pairs of labels (s, g), natural logarithm; no pairs score ``empty``."""
    cells = pairs.groupBy("s", "g").agg(F.count("*").alias("n"))
    n_s, n_g = cells.groupBy("s").agg(F.sum("n").alias("ns")), cells.groupBy("g").agg(F.sum("n").alias("ng"))
    whole = F.broadcast(cells.agg(F.sum("n").alias("total")))
    joined = cells.join(n_s, "s").join(n_g, "g").crossJoin(whole)
    p = F.col("n") / F.col("total")
    return joined.agg(F.coalesce(F.sum(p * F.ln(F.col("ng") / F.col("n"))), F.lit(empty).cast("double")).alias("split"), F.coalesce(F.sum(p * F.ln(F.col("ns") / F.col("n"))), F.lit(empty).cast("double")).alias("merge"))


def voi_of_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """``variation_of_information`` over the union of two labelled foregrounds; a missing side is label 0."""
    both = a.select(*KEY, F.col("label").alias("s")).join(b.select(*KEY, F.col("label").alias("g")), KEY, "full_outer")
    return variation_of_information(both.select(F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("g", F.lit(0)).alias("g")))


def compare(a: DataFrame, b: DataFrame, peak: float = 255.0) -> DataFrame:
    """One row (n, mae, max_abs, psnr) over common voxels; equal volumes have 99 dB."""
    d = F.abs(F.col("a") - F.col("b"))
    both = a.select(*KEY, F.col("v").cast("double").alias("a")).join(b.select(*KEY, F.col("v").cast("double").alias("b")), KEY)
    row = both.agg(F.count("*").alias("n"), F.avg(d).alias("mae"), F.max(d).alias("max_abs"), F.avg(d * d).alias("mse"))
    return row.select("n", "mae", "max_abs", F.when(F.col("mse") == 0, 99.0).otherwise(10 * F.log10(peak * peak / F.col("mse"))).alias("psnr"))


def surface(mask: DataFrame) -> DataFrame:
    """Foreground voxels with a face toward background or the outside."""
    inside = shifted(mask.select(*KEY), FACES).groupBy(*KEY).agg(F.count("*").alias("faces"))
    return mask.select(*KEY).join(inside.filter("faces = 6"), KEY, "left_anti")


def surface_dice(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """One row (nsd): share of surface voxels within ``tolerance`` of the other surface; both empty score 1."""
    r = range(-tolerance, tolerance + 1)
    ball = [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= tolerance * tolerance]
    sa, sb = surface(a), surface(b)
    near_a = sa.join(shifted(sb, ball).distinct(), KEY, "left_semi").agg(F.count("*").alias("hit_a"))
    near_b = sb.join(shifted(sa, ball).distinct(), KEY, "left_semi").agg(F.count("*").alias("hit_b"))
    row = near_a.crossJoin(near_b).crossJoin(sa.agg(F.count("*").alias("n_a"))).crossJoin(sb.agg(F.count("*").alias("n_b")))
    return row.select(_share((F.col("hit_a") + F.col("hit_b")) * 1.0, F.col("n_a") + F.col("n_b")).alias("nsd"))


def composite_score(row: DataFrame) -> DataFrame:
    """Adds ``score`` to columns topo, nsd, split, merge: weights .30, .35 and .35 of 1 / (1 + .3 VOI)."""
    return row.withColumn("score", 0.30 * F.col("topo") + 0.35 * F.col("nsd") + 0.35 / (1 + 0.3 * (F.col("split") + F.col("merge"))))


def soft_overlap(p, y, smooth: float = 1.0):
    """Column: aggregate soft Dice of probabilities and marks."""
    return (2 * F.sum(p * y) + smooth) / (F.sum(p * p) + F.sum(y * y) + smooth)


def ranking(scores: DataFrame) -> DataFrame:
    """One row (auprc, max_dice) from (p, y, id): scores that tie enter together.

    Precision and recall come from running sums over distinct scores, in ranges of scores.
    """
    levels = scores.groupBy("p").agg(F.sum("y").cast("double").alias("tp"), F.count("*").cast("double").alias("n"))
    run, total = running_sums(levels, [F.desc("p")], ["tp", "n"])
    every = F.lit(total["tp"] or None).cast("double")
    curve = run.select((F.col("tp") / every * F.col("tp_upto") / F.col("n_upto")).alias("area"), (2 * F.col("tp_upto") / (F.col("n_upto") + every)).alias("dice"))
    return curve.agg(F.sum("area").alias("auprc"), F.max("dice").alias("max_dice"))


def calibration_error(scores: DataFrame, bins: int = 15) -> DataFrame:
    """One row (ece): mean gap between confidence and accuracy over equal bins of p, by size."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    by = scores.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def split_stats(scores: DataFrame, by: str) -> DataFrame:
    """Count, mean, least, largest and sample deviation (0 for one) of ``score`` by split."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
