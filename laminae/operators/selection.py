"""Greedy selections as rounds over DataFrames: accepted sets, spanning trees, and offsets along a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.session import settled


def accepted(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id) of the set that a walk in order of ``rank`` would accept, dropping what conflicts with an accepted one.

    nodes (id, rank), ranks distinct; conflicts (a, b). Every round accepts all nodes that no undecided neighbour
    outranks and drops their neighbours, which gives the walk's result in few rounds.
    """
    both = settled(conflicts.select("a", "b").union(conflicts.select("b", "a")).filter("a <> b").distinct())
    left = settled(nodes.select("id", "rank"))
    taken = left.filter(F.lit(False)).select("id")
    while not left.isEmpty():
        rivals = both.join(left.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(left.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
        beaten = rivals.filter("rb < ra").select(F.col("a").alias("id")).distinct()
        winners = settled(left.join(beaten, "id", "left_anti").select("id"))
        losers = both.join(winners.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        taken = settled(taken.union(winners))
        left = settled(left.join(winners, "id", "left_anti").join(losers, "id", "left_anti"))
    return taken


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b, weight) of the maximum-weight forest, by rounds in which each tree takes its best outgoing edge.

    Ties go to the smaller (a, b), so the order of edges is total and the rounds make no cycle.
    """
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").filter("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight")))
    labels = settled(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("tree", F.col("id")))
    taken = edges.filter(F.lit(False))
    from laminae.operators.graph import components

    while True:
        one, two = labels.select(F.col("id").alias("a"), F.col("tree").alias("ta")), labels.select(F.col("id").alias("b"), F.col("tree").alias("tb"))
        between = edges.join(one, "a").join(two, "b").filter("ta <> tb")
        sides = between.select(F.col("ta").alias("tree"), "a", "b", "weight").union(between.select("tb", "a", "b", "weight"))
        order = F.struct(F.col("weight"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "a", "b")
        best = settled(sides.groupBy("tree").agg(F.max(order).alias("m")).select("m.a", "m.b", "m.weight").distinct())
        if best.isEmpty():
            return taken
        taken = settled(taken.union(best))
        labels = settled(components(labels.select("id"), taken).withColumnRenamed("label", "tree"))


def _ends(parents: DataFrame) -> DataFrame:
    """(id, to, delta) with every pointer followed to its end, deltas summed; each round doubles what a pointer spans."""
    while True:
        on = parents.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("delta").alias("more"))
        ahead = settled(parents.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("delta") + F.coalesce("more", F.lit(0))).alias("delta"), F.col("next").isNotNull().alias("moved")))
        parents = ahead.select("id", "to", "delta")
        if ahead.filter("moved").isEmpty():
            return parents


def tree_offsets(forest: DataFrame) -> DataFrame:
    """(id, root, offset): each node's sum of steps from its tree's least node, over edges (a, b, step: b less a).

    Trees contract: each hooks on to the least neighbour below it, chains of hooks are followed by pointer doubling,
    and edges are rewritten between what is left. So rounds grow with the logarithm of the tree, not with its depth.
    """
    kind = dict(forest.dtypes)["step"]
    edges = settled(forest.select("a", "b", "step"))
    known = settled(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("root"), F.lit(0).cast(kind).alias("offset")))
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("id"), F.col("a").alias("to"), F.col("step").alias("delta")).union(edges.select("a", "b", -F.col("step")))
        hooks = both.filter("to < id").groupBy("id").agg(F.min(F.struct("to", "delta")).alias("m")).select("id", "m.to", "m.delta")
        ends = _ends(settled(hooks))
        known = settled(known.join(ends.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"), (F.col("offset") + F.coalesce("delta", F.lit(0).cast(kind))).alias("offset")))
        one, two = (ends.select(F.col("id").alias(x), F.col("to").alias(f"t{x}"), F.col("delta").alias(f"d{x}")) for x in ("a", "b"))
        moved = edges.join(one, "a", "left").join(two, "b", "left")
        none = F.lit(0).cast(kind)
        step = F.col("step") - F.coalesce("db", none) + F.coalesce("da", none)
        edges = settled(moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), step.alias("step")).filter("a <> b"))
    return known
