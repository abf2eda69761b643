"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges of a partition, at least, between exchanges: a graph that has shrunk does not leave files in every partition.
PART_EDGES = 100_000


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Large: links each node's larger neighbours to its least one; small: its smaller neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least.hint("merge"), "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def connected_components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component: its least reachable node.

    Loops and repeated edges are harmless, edges with a null end are ignored, no edges give an empty table. A round
    is two grouped joins whose rows never exceed the edges; states are checkpointed in the shared folder. ``parts``: as
    many partitions as the edges are known to need.
    """
    prepare(edges)
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b").distinct()
    edges = (edges.coalesce(parts) if parts else edges).checkpoint()
    state = _state(edges)
    while state[0]:
        few = -(-2 * state[0] // PART_EDGES)
        edges = _stars(_stars(edges.coalesce(few), True, few), False, few).checkpoint()
        new = _state(edges)
        if new == state:
            break
        state = new
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    members = members.union(edges.select("b", "b")).distinct()
    return members.coalesce(parts) if parts else members
