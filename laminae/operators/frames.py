"""Repairs, rasters and renders over frames: tables (mesh, u, v, ...) of a surface's grid, and images of them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from laminae.functions.numeric import upper_median, wrap_difference

UV = ["mesh", "u", "v"]


def _around(cells: DataFrame, reach: int, *columns: str) -> DataFrame:
    """Each cell's columns at every place within ``reach``, itself included."""
    steps = F.array(*(F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du in range(-reach, reach + 1) for dv in range(-reach, reach + 1)))
    moved = cells.select(*UV, *columns).withColumn("_s", F.explode(steps))
    return moved.select("mesh", (F.col("u") + F.col("_s.du")).alias("u"), (F.col("v") + F.col("_s.dv")).alias("v"), *columns)


def _on_tiles(cells: DataFrame, columns: list[str], work: Callable[..., pa.Table], schema: StructType, side: int, halo: int) -> DataFrame:
    """``work`` on dense tiles of ``side`` cells a way and a halo of frames: a cell is dealt to the few tiles that see it.

    ``work`` gets the cells as a table, their places in the tile's views, a view of each of ``columns`` with NaN where no
    cell is, and which cells are the tile's own.
    """
    # a tile exists where a cell of its own does
    mine = cells.select("mesh", *(F.floor(F.col(a) / side).alias(t) for a, t in (("u", "_tu"), ("v", "_tv")))).distinct()
    dealt = cells
    for a, t in (("u", "_tu"), ("v", "_tv")):
        dealt = dealt.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - halo) / side), F.floor((F.col(a) + halo) / side))))

    def run(group: pa.Table) -> pa.Table:
        at = [group[a].to_numpy() for a in ("u", "v")]
        corner = [group[t][0].as_py() * side for t in ("_tu", "_tv")]
        place = tuple(a - (c - halo) for a, c in zip(at, corner, strict=True))
        views = []
        for c in columns:
            view = np.full((side + 2 * halo,) * 2, np.nan)
            view[place] = group[c].to_numpy()
            views.append(view)
        own = np.logical_and.reduce([(a >= c) & (a < c + side) for a, c in zip(at, corner, strict=True)])
        return work(group.drop_columns(["_tu", "_tv"]), place, views, own)

    return dealt.join(mine, ["mesh", "_tu", "_tv"], "left_semi").select(*cells.columns, "_tu", "_tv").groupBy("mesh", "_tu", "_tv").applyInArrow(run, schema)


def _upper_medians(view: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper median, number) of the cells within ``reach`` of each place of a view."""
    wide = np.pad(view, reach, constant_values=np.nan)
    span = 2 * reach + 1
    near = np.sort(np.lib.stride_tricks.sliding_window_view(wide, (span, span)).reshape(*view.shape, span * span), -1)
    n = np.isfinite(near).sum(-1)
    return np.take_along_axis(near, np.minimum(n // 2, span * span - 1)[..., None], -1)[..., 0], n


def _kept(view: np.ndarray, limit: float, least: int) -> np.ndarray:
    middle, n = _upper_medians(view, 2)
    return np.isfinite(view) & ((n < least) | (np.abs(view - middle) <= limit))


def reject_outliers(cells: DataFrame, value: str, limit: float, least: int = 5, side: int = 64) -> DataFrame:
    """``cells`` without those that lie more than ``limit`` off the upper median of the 5 x 5 cells around them.

    A place of a frame holds one cell, with a number.
    """

    def work(group, place, views, own):
        return group.filter(pa.array(own & _kept(views[0], limit, least)[place]))

    return _on_tiles(cells, [value], work, cells.schema, side, 2)


def smooth(cells: DataFrame, value: str, frame: DataFrame | None = None) -> DataFrame:
    """(mesh, u, v, value): mean of the present 3 x 3 cells; holes of ``frame`` (mesh, u, v) next to cells are filled."""
    means = _around(cells, 1, value).groupBy(*UV).agg(F.avg(value).alias(value))
    return means.join((cells if frame is None else frame).select(*UV), UV, "left_semi")


def smooth_kept(cells: DataFrame, value: str, limit: float, least: int = 5, side: int = 64) -> DataFrame:
    """``smooth`` of what ``reject_outliers`` keeps, at the places of all cells: both see the same tiles, in one exchange."""
    schema = StructType([*(cells.schema[c] for c in UV), StructField(value, DoubleType())])

    def work(group, place, views, own):
        view = np.where(_kept(views[0], limit, least), views[0], np.nan)
        wide = np.pad(view, 1, constant_values=np.nan)
        near = np.lib.stride_tricks.sliding_window_view(wide, (3, 3))
        n = np.isfinite(near).sum((-2, -1))
        mean = np.nansum(near, (-2, -1)) / np.maximum(n, 1)
        kept = own & (n[place] > 0)
        return group.select(UV).append_column(value, pa.array(mean[place])).filter(pa.array(kept))

    return _on_tiles(cells.select(*UV, value), [value], work, schema, side, 3)


def fill_gaps(cells: DataFrame, values: list[str], least: int) -> DataFrame:
    """Cells, and missing ones with at least ``least`` of eight neighbours, at their mean."""
    around = _around(cells, 1, *values).groupBy(*UV).agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in values))
    new = around.filter(F.col("_n") >= least).join(cells.select(*UV), UV, "left_anti")
    return cells.select(*UV, *(F.col(c).cast("double").alias(c) for c in values)).union(new.select(*UV, *values))


def raster(triangles: DataFrame) -> DataFrame:
    """(id, px, py, value): integer pixels inside triangles (id, u0, v0, f0, u1, ..., f2), value by barycentric weights.

    A triangle is dealt to the pixels of its own box; degenerate ones have none.
    """
    boxes = triangles
    for axis, name in (("u", "px"), ("v", "py")):
        low, high = F.ceil(F.least(*(f"{axis}{k}" for k in range(3)))), F.floor(F.greatest(*(f"{axis}{k}" for k in range(3))))
        boxes = boxes.filter(low <= high).withColumn(name, F.explode(F.sequence(low, high)))
    u, v = [F.col(f"u{k}") for k in range(3)], [F.col(f"v{k}") for k in range(3)]
    area = (u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])
    one = ((F.col("px") - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (F.col("py") - v[0])) / area
    two = ((u[1] - u[0]) * (F.col("py") - v[0]) - (F.col("px") - u[0]) * (v[1] - v[0])) / area
    weighed = boxes.filter(F.abs(area) > 1e-12).withColumns({"w1": one, "w2": two}).filter("w1 >= 0 and w2 >= 0 and w1 + w2 <= 1")
    return weighed.select("id", "px", "py", ((1 - F.col("w1") - F.col("w2")) * F.col("f0") + F.col("w1") * F.col("f1") + F.col("w2") * F.col("f2")).alias("value"))


def splat(points: DataFrame, depths: list[float], shape) -> DataFrame:
    """(z, y, x, p): the largest p of points (z, y, x, nz, ny, nx, p) whose shell along the normal holds the voxel."""
    dealt = points.withColumn("_t", F.explode(F.array(*(F.lit(float(t)) for t in depths))))
    at = dealt.select(*(F.rint(F.col(a) + F.col("_t") * F.col(f"n{a}")).cast("bigint").alias(a) for a in ("z", "y", "x")), "p")
    for a, n in zip(("z", "y", "x"), shape, strict=True):
        at = at.filter((F.col(a) >= 0) & (F.col(a) < n))
    return at.groupBy("z", "y", "x").agg(F.max("p").alias("p"))


def turns(cells: DataFrame, angle: Column) -> DataFrame:
    """Adds ``turn``: the angle in turns, continued along each row of u without jumps of half a turn or more."""
    row = Window.partitionBy("mesh", "v").orderBy("u")
    own = cells.withColumn("_t", angle / (2 * math.pi))
    step = F.coalesce(wrap_difference(F.col("_t") - F.lag("_t").over(row)), F.lit(0.0))
    first = F.first("_t").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stepped = own.withColumn("_d", step).withColumn("_f", first)
    return stepped.withColumn("turn", F.col("_f") + F.sum("_d").over(row)).drop("_t", "_d", "_f")


def mean_image(wound: DataFrame, samples: float) -> DataFrame:
    """(z, u, value): unrolled mean of v at u = round((w - least w) samples), on the full grid; empty pixels are 0."""
    from laminae.operators.winding import unroll

    sums = unroll(wound, samples)
    ends = sums.agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("u").alias("u0"), F.max("u").alias("u1"))
    grid = ends.select(F.explode(F.sequence("z0", "z1")).alias("z"), "u0", "u1").select("z", F.explode(F.sequence("u0", "u1")).alias("u"))
    return grid.join(sums, ["z", "u"], "left").select("z", "u", F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("value"))


def layers(cells: DataFrame, vox: DataFrame, offsets: list[float], shape) -> DataFrame:
    """(mesh, u, v, t, value): the volume at offsets along each cell's normal, between voxels."""
    from laminae.operators.spatial import trilinear

    dealt = cells.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in offsets))))
    points = dealt.select(F.struct(*UV, "t").alias("id"), *((F.col(a) + F.col("t") * F.col(f"n{a}")).alias(a) for a in ("z", "y", "x")))
    return trilinear(points, vox, shape).select("id.*", "value")


def prominent_peaks(profiles: DataFrame, keys: list[str], centre: int, search: int, prominence: float) -> DataFrame:
    """(keys, t): of peaks that rise by ``prominence`` on both sides, the nearest to ``centre`` within ``search``, or null.

    ``profiles`` has an array ``values``; t counts from ``centre`` (from 0). Of two as near the earlier one is taken.
    """
    n = F.size("values")

    def side(at, ahead: bool):
        """Least value from ``at`` until the first larger one, on one side."""
        rest = F.slice("values", at + 2, n) if ahead else F.reverse(F.slice("values", F.lit(1), at))
        own = F.element_at("values", at + 1)
        start = F.struct(own.alias("low"), F.lit(True).alias("on"))
        return F.aggregate(rest, start, lambda s, v: F.struct(F.when(s["on"] & (v <= own), F.least(s["low"], v)).otherwise(s["low"]).alias("low"), (s["on"] & (v <= own)).alias("on")))["low"]

    def is_peak(at):
        own = F.element_at("values", at + 1)
        local = (own >= F.element_at("values", at)) & (own >= F.element_at("values", at + 2))
        return local & (own - F.greatest(side(at, False), side(at, True)) >= prominence)

    places = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    near = F.filter(places, lambda at: (F.abs(at - centre) <= search))
    peaks = F.filter(near, is_peak)
    nearest = F.array_min(F.transform(peaks, lambda at: F.struct(F.abs(at - centre).alias("d"), at.alias("at"))))
    return profiles.select(*keys, (nearest["at"] - centre).alias("t"))
