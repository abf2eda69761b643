"""Stencils, morphology and topology over sparse volumes, as joins on shifted coordinates.

An offset list is a literal array exploded on one side, so a stencil is one equi-join or grouped count, never a range
predicate.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["z", "y", "x"]
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
CUBE = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
AROUND = [o for o in CUBE if o != (0, 0, 0)]
CORNERS = [(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
PARTS = ["vertices", "edges", "faces", "cells"]
FORWARD = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]


def shifted(vox: DataFrame, offsets: Iterable[tuple[int, int, int]]) -> DataFrame:
    """Every voxel at every offset, other columns kept."""
    steps = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x")) for z, y, x in offsets))
    rest = [c for c in vox.columns if c not in KEY]
    moved = vox.withColumn("_o", F.explode(steps))
    return moved.select(*((F.col(a) + F.col(f"_o.{a}")).alias(a) for a in KEY), *rest)


def bounded(vox: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    for axis, n in zip(KEY, shape, strict=True):
        vox = vox.filter((F.col(axis) >= 0) & (F.col(axis) < n))
    return vox


def dilate(mask: DataFrame, offsets, shape) -> DataFrame:
    """Foreground grown by the offsets, inside ``shape``."""
    return bounded(shifted(mask.select(*KEY), [*offsets, (0, 0, 0)]), shape).distinct()


def erode(mask: DataFrame, offsets, keep: int | None = None) -> DataFrame:
    """Foreground whose neighbours at all offsets are foreground; the outside is background."""
    offsets = [o for o in offsets if o != (0, 0, 0)]
    votes = shifted(mask.select(*KEY), offsets).groupBy(*KEY).agg(F.count("*").alias("votes"))
    return mask.select(*KEY).join(votes.filter(F.col("votes") >= (keep or len(offsets))), KEY, "left_semi")


def close(mask: DataFrame, offsets, shape, side: int = 32) -> DataFrame:
    """``dilate`` and then ``erode`` by symmetric offsets, in tiles of ``side`` voxels a way that see what is within reach twice."""
    reach = max(max(map(abs, o)) for o in offsets)
    tile, halo = [f"_t{a}" for a in KEY], 2 * reach
    dealt = mask.select(*(F.col(a).cast("long").alias(a) for a in KEY))
    for a, t, n in zip(KEY, tile, shape, strict=True):
        dealt = dealt.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - halo) / side), F.floor((F.col(a) + halo) / side))))
        dealt = dealt.filter((F.col(t) >= 0) & (F.col(t) * side < n))

    def moved(block: np.ndarray, o: tuple[int, int, int]) -> np.ndarray:
        """The block as seen from ``o`` steps away; what lies beyond it is background."""
        out = np.zeros_like(block)
        ends = [(slice(max(-d, 0), n - max(d, 0)), slice(max(d, 0), n - max(-d, 0))) for d, n in zip(o, block.shape, strict=True)]
        out[tuple(here for here, _ in ends)] = block[tuple(there for _, there in ends)]
        return out

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low = [int(group[t].iloc[0]) * side - halo for t in tile]
        block = np.zeros([side + 2 * halo] * 3, bool)
        block[tuple(group[a].to_numpy() - b for a, b in zip(KEY, low, strict=True))] = True
        inside = np.zeros_like(block)
        inside[tuple(slice(max(-b, 0), max(min(n - b, m), 0)) for b, n, m in zip(low, shape, block.shape, strict=True))] = True
        grown = np.logical_or.reduce([block, *(moved(block, o) for o in offsets)]) & inside
        closed = np.logical_and.reduce([grown, *(moved(grown, o) for o in offsets)])
        own = np.argwhere(closed[(slice(halo, -halo),) * 3]) + halo
        return pd.DataFrame({a: own[:, k] + low[k] for k, a in enumerate(KEY)})

    return dealt.groupBy(*tile).applyInPandas(run, "z long, y long, x long")


def majority(mask: DataFrame, shape, votes: int = 14) -> DataFrame:
    """Voxels with at least ``votes`` foreground voxels in their 3 x 3 x 3 cube."""
    return bounded(shifted(mask.select(*KEY), CUBE), shape).groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= votes).select(*KEY)


def plug(mask: DataFrame, shape) -> DataFrame:
    """Foreground, and background voxels all of whose faces touch it."""
    holes = bounded(shifted(mask.select(*KEY), FACES), shape).groupBy(*KEY).agg(F.count("*").alias("n")).filter("n = 6").select(*KEY)
    return mask.select(*KEY).union(holes).distinct()


def gradient(vox: DataFrame) -> DataFrame:
    """(z, y, x, gz, gy, gx): half central differences; a missing neighbour counts as the voxel itself."""
    out = vox.select(*KEY, "v")
    for axis in KEY:
        for step, name in ((1, "next"), (-1, "last")):
            side = vox.select(*((F.col(a) - step if a == axis else F.col(a)).alias(a) for a in KEY), F.col("v").alias(f"{name}_{axis}"))
            out = out.join(side, KEY, "left")
    return out.select(*KEY, *(((F.coalesce(f"next_{a}", "v") - F.coalesce(f"last_{a}", "v")) / 2.0).alias(f"g{a}") for a in KEY))


def line_mean(vox: DataFrame, axis: str, radius: int) -> DataFrame:
    """Mean of the present voxels within ``radius`` along an axis."""
    others = [a for a in KEY if a != axis]
    return vox.select(*KEY, F.avg("v").over(Window.partitionBy(*others).orderBy(axis).rangeBetween(-radius, radius)).alias("v"))


def weighted_line(vox: DataFrame, axis: str, weights: list[float], size: int) -> DataFrame:
    """Weighted sum along an axis; coordinates beyond the volume are reflected, missing voxels count as 0."""
    half = len(weights) // 2
    place = {a: (KEY.index(a) == KEY.index(axis)) for a in KEY}
    taps = F.array(*(F.struct(F.lit(k - half).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    moved = vox.withColumn("_t", F.explode(taps))
    at = F.col(axis) - F.col("_t.d")
    direct = moved.select(*((at if place[a] else F.col(a)).alias(a) for a in KEY), (F.col("v") * F.col("_t.w")).alias("v"))
    # a voxel also reaches, through the mirror, the voxels near either end
    low = moved.select(*(((-F.col(axis) - F.col("_t.d") - 1) if place[a] else F.col(a)).alias(a) for a in KEY), (F.col("v") * F.col("_t.w")).alias("v"))
    high = moved.select(*(((2 * size - 1 - F.col(axis) - F.col("_t.d")) if place[a] else F.col(a)).alias(a) for a in KEY), (F.col("v") * F.col("_t.w")).alias("v"))
    inside = (F.col(axis) >= 0) & (F.col(axis) < size)
    summed = direct.union(low).union(high).filter(inside).groupBy(*KEY).agg(F.sum("v").alias("v"))
    return vox.select(*KEY).join(summed, KEY)


def euler(mask: DataFrame, side: int = 32) -> DataFrame:
    """One row (vertices, edges, faces, cells, chi) of the union of closed unit cubes.

    A tile of ``side`` voxels a way counts the parts at its voxels' lower ends, which the voxels before it share, and
    voxels are dealt to the tiles that hold a part of theirs.
    """
    tile = [f"_t{a}" for a in KEY]
    dealt = mask.select(*(F.col(a).cast("long").alias(a) for a in KEY))
    for a, t in zip(KEY, tile, strict=True):
        dealt = dealt.withColumn(t, F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(a) + 1) / side))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low = [int(group[t].iloc[0]) * side - 1 for t in tile]
        block = np.zeros([side + 1] * 3, bool)
        block[tuple(group[a].to_numpy() - b for a, b in zip(KEY, low, strict=True))] = True
        counts = [0] * 4
        for thick in CORNERS:
            part = block
            for axis, whole in enumerate(thick):
                here, before = (np.take(part, range(b, b + side), axis) for b in (1, 0))
                part = here if whole else here | before
            counts[sum(thick)] += int(part.sum())
        return pd.DataFrame([counts], columns=PARTS)

    counts = dealt.groupBy(*tile).applyInPandas(run, ", ".join(f"{n} long" for n in PARTS))
    row = counts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in PARTS))
    return row.withColumn("chi", F.expr("vertices - edges + faces - cells"))


def contacts(vox: DataFrame, offsets=FORWARD) -> DataFrame:
    """(z, y, x, a, b, axis): values on either side of every contact along the forward offsets."""
    axes = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip((*KEY, "axis"), (*o, k), strict=True))) for k, o in enumerate(offsets)))
    steps = vox.withColumn("_o", F.explode(axes))
    here = steps.select(*KEY, F.col("v").alias("a"), *((F.col(a) + F.col(f"_o.{a}")).alias(f"n{a}") for a in KEY), F.col("_o.axis").alias("axis"))
    there = vox.select(*(F.col(a).alias(f"n{a}") for a in KEY), F.col("v").alias("b"))
    return here.join(there, [f"n{a}" for a in KEY]).select(*KEY, "axis", "a", "b")
