"""Graphs over voxels and patches: components, clean-up by component, topology, patch windings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.operators.stencil import AROUND, FACES, KEY, contacts, euler, shifted
from laminae.session import running_sums, settled


def _followed(parents: DataFrame) -> DataFrame:
    """(id, to) with every pointer followed to its end; each round doubles what a pointer spans."""
    while True:
        on = parents.select(F.col("id").alias("to"), F.col("to").alias("next"))
        ahead = settled(parents.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        parents = ahead.select("id", "to")
        if ahead.filter("moved").isEmpty():
            return parents


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): least id reachable over edges (a, b), for every row of nodes (id).

    Components contract: each hooks on to the least one beside it that is below it, chains of hooks are followed by
    pointer doubling, and edges are rewritten between what is left. So rounds grow with the logarithm of the longest
    chain, not with its length. Edges to what is no node do not count.
    """
    labels = settled(nodes.select("id", F.col("id").alias("label")))
    known = labels.select("id").distinct()
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    for end in ("a", "b"):
        edges = edges.join(known.withColumnRenamed("id", end), end, "left_semi")
    edges = settled(edges.select("a", "b"))
    while not edges.isEmpty():
        ends = _followed(settled(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))))
        labels = settled(labels.join(ends.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        one, two = (ends.select(F.col("id").alias(x), F.col("to").alias(f"t{x}")) for x in ("a", "b"))
        moved = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = settled(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return labels


def linear(shape: tuple[int, int, int]):
    """Scan-order id of a voxel."""
    return (F.col("z") * shape[1] + F.col("y")) * shape[2] + F.col("x")


def _local_roots(at: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """Index of the first voxel, in the order given, of each voxel's component: ``at`` (n x 3), offsets pointing forward.

    Trees of least indices: each tree hooks on to the least one beside it, and paths are halved until they end.
    """
    at = at - at.min(0)
    reach = max(max(map(abs, o)) for o in offsets)
    grid = np.full(tuple(at.max(0) + 1 + 2 * reach), -1, np.int64)
    place = tuple(at[:, k] + reach for k in range(3))
    grid[place] = np.arange(len(at))
    pairs = []
    for o in offsets:
        other = grid[tuple(c + d for c, d in zip(place, o, strict=True))]
        has = np.flatnonzero(other >= 0)
        pairs.append(np.stack([has, other[has]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(len(at))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def voxel_components(mask: DataFrame, shape: tuple[int, int, int], full: bool = False, side: int = 32) -> DataFrame:
    """(z, y, x, label) under 6- or 26-connectivity; label: least scan-order id of the component.

    Chunk by chunk first: a task labels a chunk of ``side`` voxels a way by itself, so only voxels on chunk faces meet
    across chunks, and rounds run over the graph of chunks' components, not of voxels.
    """
    offsets = [o for o in (AROUND if full else FACES) if o > (0, 0, 0)]
    chunk = [f"_c{a}" for a in KEY]

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(KEY)
        ids = group["id"].to_numpy()
        return group.assign(root=ids[_local_roots(group[KEY].to_numpy(), offsets)])[[*KEY, "id", "root"]]

    dealt = mask.select(*(F.col(a).cast("long").alias(a) for a in KEY), linear(shape).cast("long").alias("id"), *(F.floor(F.col(a) / side).alias(c) for a, c in zip(KEY, chunk, strict=True)))
    here = settled(dealt.groupBy(*chunk).applyInPandas(label, "z long, y long, x long, id long, root long"))
    edge = F.lit(False)
    for a in KEY:
        edge = edge | (F.pmod(a, F.lit(side)) == 0) | (F.pmod(a, F.lit(side)) == side - 1)
    rim = here.filter(edge)
    apart = F.lit(False)
    for a in KEY:
        apart = apart | (F.floor(F.col(a) / side) != F.floor(F.col(f"from_{a}") / side))
    steps = shifted(rim.select(*KEY, *(F.col(a).alias(f"from_{a}") for a in KEY), F.col("root").alias("a")), offsets).filter(apart)
    faces = settled(steps.join(rim.select(*KEY, F.col("root").alias("b")), KEY).select("a", "b").distinct())
    nodes = faces.select(F.col("a").alias("id")).union(faces.select("b")).distinct()
    merged = components(nodes, faces).withColumnRenamed("id", "root")
    return here.join(merged, "root", "left").select(*KEY, F.coalesce("label", "root").alias("label"))


def compact(labels: DataFrame) -> DataFrame:
    """Labels as 1, 2, ... in order of first occurrence; the distinct labels are ranked, not the voxels."""
    ids = running_sums(labels.select("label").distinct().withColumn("one", F.lit(1).cast("long")), ["label"], ["one"])[0]
    return labels.join(ids, "label").select(*KEY, F.col("one_upto").cast("int").alias("label"))


def remove_small(labels: DataFrame, least: int) -> DataFrame:
    """Voxels of components of at least ``least`` voxels."""
    big = labels.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return labels.join(big, "label", "left_semi").select(*KEY, "label")


def background(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    spark = mask.sparkSession
    total = shape[0] * shape[1] * shape[2]
    grid = spark.range(total).select(F.floor(F.col("id") / (shape[1] * shape[2])).alias("z"), (F.floor(F.col("id") / shape[2]) % shape[1]).alias("y"), (F.col("id") % shape[2]).alias("x"))
    return grid.join(mask.select(*KEY), KEY, "left_anti")


def holes(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, label): background components, by faces, that do not touch the border."""
    labels = voxel_components(background(mask, shape), shape)
    edge = None
    for axis, n in zip(KEY, shape, strict=True):
        here = (F.col(axis) == 0) | (F.col(axis) == n - 1)
        edge = here if edge is None else edge | here
    return labels.join(labels.filter(edge).select("label").distinct(), "label", "left_anti").select(*KEY, "label")


def fill_holes(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return mask.select(*KEY).union(holes(mask, shape).select(*KEY))


def betti(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """One row (b0, b1, b2, chi): components, tunnels and cavities."""
    b0 = voxel_components(mask, shape, full=True).agg(F.countDistinct("label").alias("b0"))
    b2 = holes(mask, shape).agg(F.countDistinct("label").alias("b2"))
    row = b0.crossJoin(b2).crossJoin(euler(mask).select("chi"))
    return row.select("b0", (F.col("b0") + F.col("b2") - F.col("chi")).alias("b1"), "b2", "chi")


def connect_fragments(labels: DataFrame, offsets, shape) -> DataFrame:
    """Background voxels that see two components or more at the offsets."""
    from laminae.operators.stencil import bounded

    seen = bounded(shifted(labels.select(*KEY, "label"), offsets), shape).groupBy(*KEY).agg(F.countDistinct("label").alias("n")).filter("n >= 2")
    return seen.select(*KEY).join(labels.select(*KEY), KEY, "left_anti")


def signed_affinity(contacts: DataFrame, attract: float, repel: float) -> DataFrame:
    """Weight of each voxel contact: attraction along the sheet less repulsion across it, by the pair's values."""
    across = F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a"), F.col("b"), F.lit(1))
    return contacts.select(*KEY, "axis", (attract * (1 - across) - repel * across).alias("w"))


def stitch_offsets(faces: DataFrame, tolerance: float) -> DataFrame:
    """Blocks' face measurements (a, b, d, n) to whole steps: offset round(d), quality, and conflict."""
    q = 1 - 2 * F.abs(F.col("d") - F.round("d"))
    return faces.select("a", "b", F.round("d").cast("bigint").alias("step"), (q * F.col("n")).alias("weight"), (F.abs(F.col("d") - F.round("d")) > tolerance).alias("conflict"))


def block_faces(blocks: DataFrame) -> DataFrame:
    """(z, y, x, axis, d, q): difference of a block's value (z, y, x, v) to that of the next block along each axis, and how
    near it is to a whole step: 1 there, 0 half way."""
    d = F.col("b") - F.col("a")
    return contacts(blocks).select(*KEY, "axis", d.alias("d"), (1 - 2 * F.abs(d - F.rint(d))).alias("q"))
