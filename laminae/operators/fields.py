"""Scalar fields over volumes: block-wise phase unwrapping, stitching of blocks, and relaxed winding fields.

Voxels are rows; a task sees one block and its halo as dense arrays, so groups are bounded by the block's size. Blocks
exchange halos by rows dealt to every block that needs them. States of iterations are checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.operators.graph import components
from laminae.operators.selection import spanning_forest, tree_offsets
from laminae.session import settled

KEY = ["z", "y", "x"]
CELL = ["cz", "cy", "cx"]


def on_blocks(vox: DataFrame, inputs: list[str], work: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], outputs: list[str], side: int, halo: int, whole: bool = False) -> DataFrame:
    """(z, y, x, outputs): ``work`` on dense blocks of ``side`` voxels a way and a halo, as far as there are voxels.

    ``work`` gets arrays by name, 0 where no voxel is, and the mask of voxels; it returns arrays. Rows of the block's own
    voxels come back; ``whole``: those of its halo too, with the block (cz, cy, cx) they were seen from.
    """
    dealt = vox.select(*(F.col(a).cast("long").alias(a) for a in KEY), *(F.col(c).cast("double").alias(c) for c in inputs))
    for a, c in zip(KEY, CELL, strict=True):
        dealt = dealt.withColumn(c, F.explode(F.sequence(F.floor((F.col(a) - halo) / side), F.floor((F.col(a) + halo) / side))))
    # a block exists where a voxel of its own does
    own = vox.select(*(F.floor(F.col(a) / side).alias(c) for a, c in zip(KEY, CELL, strict=True))).distinct()
    if halo:
        dealt = dealt.join(own, CELL, "left_semi")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        corner = [int(group[c].iloc[0]) * side for c in CELL]
        at = [group[a].to_numpy() for a in KEY]
        low = [int(a.min()) for a in at]
        place = tuple(a - b for a, b in zip(at, low, strict=True))
        shape = tuple(int(p.max()) + 1 for p in place)
        live = np.zeros(shape, bool)
        live[place] = True
        arrays = {}
        for c in inputs:
            arrays[c] = np.zeros(shape)
            arrays[c][place] = group[c].to_numpy()
        # the view's first voxel in the volume, and the block's own in the view
        arrays["_low"], arrays["_own"] = np.array(low), np.array(corner) - low
        out = work(arrays, live)
        kept = np.ones(len(group), bool)
        if not whole:
            kept = np.logical_and.reduce([(a >= c) & (a < c + side) for a, c in zip(at, corner, strict=True)])
        frame = group[kept]
        return pd.DataFrame({**{c: frame[c] for c in (*KEY, *(CELL if whole else ()))}, **{name: out[name][place][kept] for name in outputs}})

    schema = ", ".join(f"{c} long" for c in (*KEY, *(CELL if whole else ()))) + ", " + ", ".join(f"{name} double" for name in outputs)
    return dealt.groupBy(*CELL).applyInPandas(run, schema)


# phase unwrapping


def wrapped(a):
    """Difference of two phases of period one, nearest to zero."""
    return a - np.floor(a + 0.5)


def _cosines(n: int) -> np.ndarray:
    """Orthonormal cosine transform (type II) of length n, as a matrix."""
    k = np.arange(n)
    out = np.sqrt(2 / n) * np.cos(np.pi * (k[None, :] + 0.5) * k[:, None] / n)
    out[0] /= np.sqrt(2)
    return out


def _along(matrix: np.ndarray, block: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(matrix, block, (1, axis)), 0, axis)


def _poisson(shape: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of the graph Laplacian of a full box, constants out: diagonal in cosines, one small matrix an axis."""
    bases = [_cosines(n) for n in shape]
    values = sum(np.reshape(2 - 2 * np.cos(np.pi * np.arange(n) / n), [-1 if k == axis else 1 for k in range(3)]) for axis, n in enumerate(shape))
    values.flat[0] = 1.0

    def solve(rhs: np.ndarray) -> np.ndarray:
        for axis, basis in enumerate(bases):
            rhs = _along(basis, rhs, axis)
        rhs = rhs / values
        rhs.flat[0] = 0.0
        for axis, basis in enumerate(bases):
            rhs = _along(basis.T, rhs, axis)
        return rhs

    return solve


def _pulled(flows: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """What flows along the three axes' edges add up to at voxels (the adjoint of forward differences)."""
    out = np.zeros(shape)
    for axis, flow in enumerate(flows):
        before = [(0, 0)] * 3
        after = [(0, 0)] * 3
        before[axis], after[axis] = (1, 0), (0, 1)
        out += np.pad(flow, before) - np.pad(flow, after)
    return out


def unwrap_dense(phase: np.ndarray, trust: np.ndarray, rounds: int = 200, tolerance: float = 1e-18) -> tuple[np.ndarray, float]:
    """(u, relative residual): least squares of u's differences against wrapped ones, edges weighted by the lesser trust, squared.

    Conjugate gradients on the weighted Laplacian, preconditioned by the unweighted one; u is free up to a constant.
    """
    wants, weights = [], []
    for axis in range(3):
        ends = [np.take(trust, range(k, trust.shape[axis] - 1 + k), axis) for k in (0, 1)]
        wants.append(wrapped(np.diff(phase, axis=axis)))
        weights.append(np.maximum(np.minimum(*ends) ** 2, 1e-3))
    shape = phase.shape

    def laplacian(u: np.ndarray) -> np.ndarray:
        return _pulled([np.diff(u, axis=axis) * w for axis, w in enumerate(weights)], shape)

    solve = _poisson(shape)
    u = np.zeros(shape)
    left = _pulled([d * w for d, w in zip(wants, weights, strict=True)], shape)
    scale = max(float((left * left).sum()), 1e-30)
    ahead = solve(left)
    way = ahead
    gain = float((left * ahead).sum())
    for _ in range(rounds):
        if (left * left).sum() / scale < tolerance or gain <= 0:
            break
        pushed = laplacian(way)
        step = gain / float((way * pushed).sum())
        u, left = u + step * way, left - step * pushed
        ahead = solve(left)
        gain, last = float((left * ahead).sum()), gain
        way = ahead + gain / last * way
    return u, float((left * left).sum() / scale)


def unwrap_blocks(vox: DataFrame, side: int, halo: int, trusted: float = 0.5) -> DataFrame:
    """(z, y, x, cz, cy, cx, u, trust): each block's phases ``w`` (period one), halo and all, as a continuous field u.

    u keeps w's fraction: after the least squares, u is moved by the trusted voxels' mean difference to w and then to the
    nearest value with w's fraction. It is free up to a whole number for each block. Voxels that are absent weigh nothing.
    """

    def work(arrays, live):
        trust = np.where(live, arrays["trust"], 0.0)
        u, _ = unwrap_dense(arrays["w"], trust)
        sure = trust > trusted if (trust > trusted).any() else live
        turn = 2j * np.pi * (arrays["w"] - u)[sure]
        u = u + np.angle(np.exp(turn).mean()) / (2 * np.pi)
        return {"u": arrays["w"] + np.round(u - arrays["w"]), "trust": arrays["trust"]}

    return on_blocks(vox, ["w", "trust"], work, ["u", "trust"], side, halo, whole=True)


def overlap_steps(blocks: DataFrame, least: int, trusted: float = 0.5) -> DataFrame:
    """(a, b, d, n): median difference of two blocks' fields where both see a trusted voxel, of ``least`` voxels at least.

    ``blocks``: (z, y, x, block, u, trust). Only blocks that share voxels meet, each voxel in the few blocks it is in.
    """
    seen = blocks.filter(F.col("trust") > trusted).select(*KEY, "block", "u")
    one = seen.select(*KEY, F.col("block").alias("a"), F.col("u").alias("ua"))
    two = seen.select(*KEY, F.col("block").alias("b"), F.col("u").alias("ub"))
    pairs = one.join(two, KEY).filter("a < b")
    met = pairs.groupBy("a", "b").agg(F.percentile(F.col("ua") - F.col("ub"), 0.5).alias("d"), F.count("*").alias("n"))
    return met.filter(F.col("n") >= least)


def stitch_blocks(blocks: DataFrame, least: int = 200, trusted: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((block, root, offset) of every block, (a, b, residual) of every overlap): whole steps along the best-covered forest.

    Adding its offset to a block's field makes neighbours agree; a residual other than 0 is a loop that does not close.
    """
    steps = settled(overlap_steps(blocks, least, trusted))
    taken = spanning_forest(steps.select("a", "b", F.col("n").cast("double").alias("weight"))).select("a", "b").join(steps, ["a", "b"])
    offsets = settled(tree_offsets(taken.select("a", "b", F.round("d").cast("long").alias("step"))))
    lone = blocks.select("block").distinct().join(offsets, blocks["block"] == offsets["id"], "left_anti")
    every = offsets.select(F.col("id").alias("block"), "root", "offset").union(lone.select("block", F.col("block").alias("root"), F.lit(0).cast("long")))
    ends = [every.select(F.col("block").alias(x), F.col("offset").alias(f"o{x}")) for x in ("a", "b")]
    loops = steps.join(ends[0], "a").join(ends[1], "b").select("a", "b", (F.col("d") - (F.col("ob") - F.col("oa"))).alias("residual"))
    return every, loops


def wrap_numbers(vox: DataFrame, side: int, halo: int, shape: tuple[int, int, int], least: int = 200) -> DataFrame:
    """(z, y, x, u, wrap, part): phases (z, y, x, w, trust) unwrapped block by block and stitched; wrap is the nearest whole.

    ``part`` is the least block of those that overlaps tie together; windings of different parts do not compare.
    """
    across = [-(-n // side) for n in shape]
    block = (F.col("cz") * across[1] + F.col("cy")) * across[2] + F.col("cx")
    solved = settled(unwrap_blocks(vox, side, halo).withColumn("block", block))
    offsets, _ = stitch_blocks(solved, least)
    inside = F.lit(True)
    for a, c in zip(KEY, CELL, strict=True):
        inside = inside & (F.floor(F.col(a) / side) == F.col(c))
    own = solved.filter(inside).join(offsets, "block").withColumn("u", F.col("u") + F.col("offset"))
    return own.select(*KEY, "u", F.round("u").cast("long").alias("wrap"), F.col("root").alias("part"))


# relaxed fields


def _neighbours(u: np.ndarray, live: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sum over live neighbours of what they say of a voxel, number of them); steps are wanted differences to the next voxel."""
    total, count = np.zeros(u.shape), np.zeros(u.shape)
    for axis in range(3):
        here = tuple(slice(0, -1) if k == axis else slice(None) for k in range(3))
        there = tuple(slice(1, None) if k == axis else slice(None) for k in range(3))
        both = live[here] & live[there]
        total[here] += np.where(both, u[there] - steps[axis], 0.0)
        total[there] += np.where(both, u[here] + steps[axis], 0.0)
        count[here] += both
        count[there] += both
    return total, count


def _sweeps(sweeps: int):
    def work(arrays, live):
        u, held = arrays["v"].copy(), arrays["fixed"] > 0
        slopes = [arrays[f"g{a}"] for a in KEY]
        steps = []
        for axis in range(3):
            ends = [np.take(slopes[axis], range(k, u.shape[axis] - 1 + k), axis) for k in (0, 1)]
            steps.append((ends[0] + ends[1]) / 2)
        odd = sum(np.reshape(np.arange(n) + b, [-1 if k == axis else 1 for k in range(3)]) for axis, (n, b) in enumerate(zip(u.shape, arrays["_low"], strict=True))) % 2
        for colour in (0, 1) * sweeps:
            total, count = _neighbours(u, live, steps)
            move = live & ~held & (odd == colour) & (count > 0)
            u[move] = total[move] / count[move]
        return {"v": u, "moved": np.abs(u - arrays["v"])}

    return work


_STATE = ["v", "fixed", "gz", "gy", "gx"]


def relaxed(field: DataFrame, sweeps: int, side: int) -> DataFrame:
    """``field`` (z, y, x, v, fixed, gz, gy, gx) and ``moved`` after red-black sweeps, even voxels first.

    A voxel that is not fixed becomes the mean of what its live neighbours say: their value and the mean slope between.
    What is missing says nothing. The halo is as deep as the sweeps reach, so block sizes do not show.
    """
    out = on_blocks(field, _STATE, _sweeps(sweeps), ["v", "moved"], side, 2 * sweeps)
    return out.join(field.select(*KEY, *_STATE[1:]), KEY).select(*KEY, *_STATE, "moved")


def _coarser(field: DataFrame) -> DataFrame:
    """Every other voxel a way: means, fixed where any is (mean of those), slopes twice as steep a step."""
    cell = [F.floor(F.col(a) / 2).alias(a) for a in KEY]
    held = F.avg(F.when(F.col("fixed") > 0, F.col("v")))
    slopes = [(2 * F.avg(f"g{a}")).alias(f"g{a}") for a in KEY]
    return field.groupBy(*cell).agg(F.coalesce(held, F.avg("v")).alias("v"), F.max("fixed").alias("fixed"), *slopes)


def _settled_block(side: int, halo: int, tolerance: float):
    """Solves a block and its halo at once, by conjugate gradients; the halo's outermost layer is held as it is."""

    def work(arrays, live):
        u, own = arrays["v"].copy(), arrays["_own"]
        steps = []
        for axis, a in enumerate(KEY):
            ends = [np.take(arrays[f"g{a}"], range(k, u.shape[axis] - 1 + k), axis) for k in (0, 1)]
            steps.append((ends[0] + ends[1]) / 2)
        free = live & (arrays["fixed"] <= 0)
        for axis, n in enumerate(u.shape):
            at = np.arange(n)
            rim = (at == own[axis] - halo) | (at == own[axis] + side + halo - 1)
            free &= ~np.reshape(rim, [-1 if k == axis else 1 for k in range(3)])
        none = [np.zeros_like(s) for s in steps]
        total, count = _neighbours(u, live, steps)
        left = np.where(free, total - count * u, 0.0)
        way, gain = left.copy(), float((left * left).sum())
        while np.abs(left).max(initial=0.0) > tolerance:
            total, count = _neighbours(way, live, none)
            pushed = np.where(free, count * way - total, 0.0)
            step = gain / float((way * pushed).sum())
            u, left = u + step * way, left - step * pushed
            gain, last = float((left * left).sum()), gain
            way = left + gain / last * way
        return {"v": u, "moved": np.abs(u - arrays["v"])}

    return work


def relax_until(field: DataFrame, tolerance: float, side: int = 32, levels: int = 0) -> DataFrame:
    """(z, y, x, v): ``field`` (z, y, x, v, fixed, gz, gy, gx) where each free voxel is what its neighbours say on average.

    A round settles every block with its halo, a quarter of the block deep, and keeps the block's own voxels; halos are
    exchanged and rounds go on until none moves by more than ``tolerance``. ``levels``: the start is the same on a grid
    twice as coarse, so many times over; it changes the number of rounds and not where they end.
    """
    if levels:
        start = relax_until(_coarser(field), tolerance, side, levels - 1).withColumnRenamed("v", "start")
        cell = [F.floor(F.col(a) / 2).alias(f"_{a}") for a in KEY]
        start = start.select(*(F.col(a).alias(f"_{a}") for a in KEY), "start")
        # half a coarse step off the middle, along the slope
        lean = sum(((F.pmod(a, F.lit(2)) - 0.5) * F.col(f"g{a}") for a in KEY), F.lit(0.0))
        value = F.when(F.col("fixed") > 0, F.col("v")).otherwise(F.col("start") + lean)
        field = field.select(*KEY, *_STATE, *cell).join(start, [f"_{a}" for a in KEY]).select(*KEY, value.alias("v"), *_STATE[1:])
    state, halo = settled(field.select(*KEY, *(F.col(c).cast("double").alias(c) for c in _STATE))), max(2, side // 4)
    rest = state.select(*KEY, *_STATE[1:])
    while True:
        after = settled(on_blocks(state, _STATE, _settled_block(side, halo, tolerance / 10), ["v", "moved"], side, halo))
        if (after.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return after.select(*KEY, "v")
        state = after.select(*KEY, "v").join(rest, KEY)


def dirichlet_field(anchors: DataFrame, domain: DataFrame, tolerance: float, side: int = 32, levels: int = 2) -> DataFrame:
    """(z, y, x, v): windings of a domain of voxels that are harmonic between anchors (z, y, x, w); several: their mean."""
    pinned = anchors.groupBy(*KEY).agg(F.avg("w").alias("w"))
    middle = pinned.agg(F.avg("w").alias("m"))
    flat = [F.lit(0.0).alias(f"g{a}") for a in KEY]
    field = domain.select(*KEY).join(pinned, KEY, "left").crossJoin(F.broadcast(middle))
    return relax_until(field.select(*KEY, F.coalesce("w", "m").alias("v"), F.col("w").isNotNull().cast("double").alias("fixed"), *flat), tolerance, side, levels=levels)


def eulerian_field(normals: DataFrame, spacing: float, tolerance: float, side: int = 32, levels: int = 2) -> DataFrame:
    """(z, y, x, v): the field whose slope best matches normals (z, y, x, nz, ny, nx) over ``spacing``, of mean 0.

    Edges to voxels that are missing are left out, so a ramp runs up to the rim. Windings compare within a component.
    """
    slopes = [(F.col(f"n{a}") / spacing).alias(f"g{a}") for a in KEY]
    field = relax_until(normals.select(*KEY, F.lit(0.0).alias("v"), F.lit(0.0).alias("fixed"), *slopes), tolerance, side, levels=levels)
    mean = field.agg(F.avg("v").alias("m"))
    return field.crossJoin(F.broadcast(mean)).select(*KEY, (F.col("v") - F.col("m")).alias("v"))


# signed graphs


def mutex_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): clusters of a signed graph (a, b, w), strongest edge first: attraction merges two clusters unless a
    repulsion between them came first. Ties: the smaller (a, b). label: the least id of the cluster.

    Rounds in place of the walk. Every cluster looks at its strongest edge. If it repels, the walk will bar these two, and
    they are barred now. If it attracts, it merges for sure when it is also the other's strongest, or when nothing bars
    the cluster, as bars on it can only come from weaker edges. Of edges between two clusters the strongest decides, so
    there is one; edges between barred clusters go.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    order = F.struct(F.abs("w").alias("size"), (-a).alias("na"), (-b).alias("nb"))
    edges = settled(edges.filter("a <> b and w <> 0").select(a.alias("a"), b.alias("b"), order.alias("rank"), (F.col("w") > 0).alias("pull")))
    labels = settled(nodes.select("id", F.col("id").alias("label")))
    bars = settled(edges.select("a", "b").limit(0))
    while True:
        edges = edges.groupBy("a", "b").agg(F.max(F.struct("rank", "pull")).alias("e")).select("a", "b", "e.rank", "e.pull")
        edges = settled(edges.join(bars, ["a", "b"], "left_anti"))
        if edges.isEmpty():
            return labels
        ends = edges.select(F.col("a").alias("id"), "a", "b", "rank", "pull").union(edges.select("b", "a", "b", "rank", "pull"))
        best = ends.groupBy("id").agg(F.max(F.struct("rank", "a", "b", "pull")).alias("e")).select("id", "e.a", "e.b", "e.pull")
        barred = bars.select(F.col("a").alias("id")).union(bars.select("b")).distinct().withColumn("barred", F.lit(True))
        best = best.join(barred, "id", "left")
        votes = settled(best.groupBy("a", "b").agg(F.first("pull").alias("pull"), F.count("*").alias("n"), F.max(F.col("barred").isNull()).alias("free")))
        joined = settled(votes.filter("pull and (n = 2 or free)").select("a", "b"))
        bars = bars.union(votes.filter("not pull").select("a", "b"))
        ids = joined.select(F.col("a").alias("id")).union(joined.select("b")).distinct()
        moved = settled(components(ids, joined).select(F.col("id").alias("old"), F.col("label").alias("new")))

        def renamed(table: DataFrame, column: str) -> DataFrame:
            rest = [c for c in table.columns if c != column]
            return table.join(moved, table[column] == moved["old"], "left").select(F.coalesce("new", column).alias(column), *rest)  # noqa: B023 (read at once)

        labels = settled(renamed(labels, "label").select("id", "label"))
        tables = []
        for table in (edges, bars):
            both = renamed(renamed(table, "a"), "b").filter("a <> b")
            tables.append(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(c for c in both.columns if c not in ("a", "b"))))
        edges, bars = tables[0], settled(tables[1].distinct())
