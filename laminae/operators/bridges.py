"""From measurements to constraints and offsets: gates, tables, signs and residuals over patch and block graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminae.operators.selection import spanning_forest, tree_offsets
from laminae.operators.series import islands
from laminae.session import settled


def constraints(points: DataFrame, least: float, stride: int, order: str) -> DataFrame:
    """Points that may bind a fit: confident ones, every ``stride``-th number of ``order``."""
    return points.filter((F.col("conf") >= least) & (F.pmod(F.col(order), F.lit(stride)) == 0))


def constraint_table(points: DataFrame, by: str, gap: float) -> DataFrame:
    """(by, island, n, w, r, sd): clusters of windings less than ``gap`` apart: mean winding, mean and population deviation of r."""
    return islands(points.select(by, "w", "r"), by, "w", gap).groupBy(by, "island").agg(F.count("*").alias("n"), F.avg("w").alias("w"), F.avg("r").alias("r"), F.stddev_pop("r").alias("sd"))


def offset_gates(pairs: DataFrame, least: int, spread: float) -> DataFrame:
    """(a, b, n, d, mad): median offset of two meshes from (a, b, d), where enough pairs agree on it."""
    middle = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("m"))
    spreads = pairs.join(middle, ["a", "b"]).groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("d"), F.percentile(F.abs(F.col("d") - F.col("m")), 0.5).alias("mad"))
    return spreads.filter((F.col("n") >= least) & (F.col("mad") <= spread))


def _steps(edges: DataFrame, step: Column) -> DataFrame:
    """The edges of the heaviest forest, from the smaller to the larger end, with their step."""
    both = edges.select("a", "b", step.cast("long").alias("step"), "weight").union(edges.select("b", "a", -step.cast("long"), "weight"))
    best = both.groupBy("a", "b").agg(F.max_by("step", "weight").alias("step"))
    return spanning_forest(edges.select("a", "b", "weight")).join(best, ["a", "b"]).select("a", "b", "step")


def residuals(edges: DataFrame) -> DataFrame:
    """(a, b, residual): what edges (a, b, d, weight) say against the whole offsets along the heaviest forest."""
    edges = settled(edges.select("a", "b", "d", "weight"))
    offsets = settled(tree_offsets(_steps(edges, F.round("d"))))
    ends = [offsets.select(F.col("id").alias(x), F.col("offset").alias(f"o{x}")) for x in ("a", "b")]
    return edges.join(ends[0], "a").join(ends[1], "b").select("a", "b", (F.col("d") - (F.col("ob") - F.col("oa"))).alias("residual"))


def signs(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, root, sign): +1 or -1 of each patch, so that conormals (a, b, conormal) of the strongest forest turn positive.

    Conormals weaker than ``least`` bind nothing.
    """
    strong = settled(edges.filter(F.abs("conormal") >= least).select("a", "b", "conormal", F.abs("conormal").alias("weight")))
    flips = tree_offsets(_steps(strong, (F.col("conormal") < 0).cast("long")))
    return flips.select("id", "root", F.when(F.pmod("offset", F.lit(2)) == 0, 1).otherwise(-1).alias("sign"))


def label_trust(vox: DataFrame, shape, least: float, size: int) -> DataFrame:
    """(z, y, x, label): confident voxels, less their outer layer, in face-connected parts of at least ``size`` voxels."""
    from laminae.operators.graph import remove_small, voxel_components
    from laminae.operators.stencil import FACES, erode

    core = settled(erode(vox.filter(F.col("v") >= least), FACES))
    return remove_small(voxel_components(core, shape), size)


def suppressed(seeds: DataFrame, radius: float) -> DataFrame:
    """Seeds (id, score, z, y, x) that a walk from the best one on keeps, each dropping those within ``radius``."""
    from laminae.operators.selection import accepted
    from laminae.operators.spatial import near_pairs

    ranked = seeds.select("id", F.struct((-F.col("score")).alias("s"), "id").alias("rank"))
    close = near_pairs(seeds.select("id", "z", "y", "x"), seeds.select("id", "z", "y", "x"), radius).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return seeds.join(accepted(ranked, close), "id", "left_semi")
