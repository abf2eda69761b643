"""Winding numbers: initial fields, fits, checks, labels and the unrolled image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminae.functions.numeric import polar, upper_median, winding


def field(vox: DataFrame, axis: DataFrame, pitch: float, places: int = 9) -> DataFrame:
    """(z, y, x, v, w): winding about the axis (z, cy, cx), rounded so that bins are stable."""
    joined = vox.join(axis, "z")
    w = winding(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"), pitch)
    return joined.select("z", "y", "x", "v", F.round(w, places).alias("w"))


def unroll(wound: DataFrame, samples: float) -> DataFrame:
    """(z, u, n, total): voxels and their sum by slice and winding column, counted from the least winding."""
    least = wound.agg(F.min("w").alias("w0"))
    column = F.round((F.col("w") - F.col("w0")) * samples).cast("bigint")
    return wound.crossJoin(F.broadcast(least)).groupBy("z", column.alias("u")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def spiral_fit(vox: DataFrame, cy: float, cx: float) -> DataFrame:
    """One row (a, b, rms) of r = a + b theta by least squares; zeros if degenerate."""
    r, t = polar(F.col("y") - cy, F.col("x") - cx)
    p = vox.select(r.alias("r"), t.alias("t"))
    s = p.agg(F.count("*").alias("n"), F.sum("t").alias("st"), F.sum("r").alias("sr"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("t") * F.col("r")).alias("str"), F.sum(F.col("r") * F.col("r")).alias("srr"))
    den = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    flat = (F.col("n") < 2) | (F.abs(den) < 1e-12)
    b = F.when(flat, 0.0).otherwise((F.col("n") * F.col("str") - F.col("st") * F.col("sr")) / den)
    fit = s.withColumn("b", b).withColumn("a", F.when(flat, 0.0).otherwise((F.col("sr") - F.col("b") * F.col("st")) / F.col("n")))
    error = F.col("srr") - 2 * F.col("a") * F.col("sr") - 2 * F.col("b") * F.col("str") + F.col("n") * F.col("a") * F.col("a") + 2 * F.col("a") * F.col("b") * F.col("st") + F.col("b") * F.col("b") * F.col("stt")
    return fit.select("a", "b", F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(error, F.lit(0.0)) / F.col("n"))).alias("rms"))


def wrap_label(wound: DataFrame, least: float, wraps: int, buffer: float) -> DataFrame:
    """Instance labels: 0 below ``least``, 255 outside the model or between wraps, else 1 + wrap mod ``wraps``."""
    w = F.col("w")
    near = F.round(w)
    label = F.when(F.col("v") < least, 0).when(w.isNull() | F.isnan(w) | (near < 0) | (F.abs(w - near) > buffer), 255)
    return wound.select("z", "y", "x", label.otherwise(1 + F.pmod(near, F.lit(float(wraps)))).cast("int").alias("label"))


def violations(wound: DataFrame) -> DataFrame:
    """One row (steps, bad): steps outward along x in a row of voxels where the winding does not rise."""
    w = Window.partitionBy("z", "y").orderBy("x")
    steps = wound.select(F.lag("w").over(w).alias("before"), "w").filter("before is not null")
    return steps.agg(F.count("*").alias("steps"), F.sum((F.col("w") <= F.col("before")).cast("bigint")).alias("bad"))


def wrap_surface(wraps: DataFrame, pitch: float, columns: int, cy: float, cx: float) -> DataFrame:
    """(wrap, u, y, x): the closed-form spiral r = pitch (wrap + turn), sampled at ``columns`` angles."""
    u = wraps.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    turn = F.col("u") / float(columns)
    r, t = pitch * (F.col("wrap") + turn), 2 * math.pi * turn
    return u.select("wrap", "u", (cy + r * F.sin(t)).alias("y"), (cx + r * F.cos(t)).alias("x"))


def gauge(residuals: DataFrame, by: str, least: int) -> DataFrame:
    """(by, base): upper median of each component's residual; small components and wild residuals are skipped."""
    kept = residuals.filter(F.abs("residual") < 1e30)
    return kept.groupBy(by).agg(upper_median("residual").alias("base"), F.count("*").alias("n")).filter(F.col("n") >= least).select(by, "base")


def fit_loss(points: DataFrame, groups: str, weight: float) -> DataFrame:
    """One row (loss): weighted mean square of (w - target) and ``weight`` times the groups' population variance."""
    e = F.col("w") - F.col("target")
    data = points.agg((F.sum(F.col("weight") * e * e) / F.count("*")).alias("data"))
    spread = points.groupBy(groups).agg(F.var_pop("w").alias("var"), F.count("*").alias("k")).filter("k >= 2").agg(F.coalesce(F.sum("var"), F.lit(0.0)).alias("spread"))
    return data.crossJoin(spread).select((F.col("data") + weight * F.col("spread")).alias("loss"))
