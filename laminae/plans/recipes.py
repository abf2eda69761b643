"""Named stages and recipes: an ordered list of stages, each a function of DataFrames, declared in TOML."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame

from laminae.operators import dense, graph, stencil, voxel

STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(name: str):
    """Registers a function (volume, **parameters) -> volume under a name; names are unique."""

    def register(f):
        if name in STAGES:
            raise ValueError(f"stage {name} is registered twice")
        STAGES[name] = f
        return f

    return register


@stage("threshold")
def _threshold(vox: DataFrame, t: float | None = None) -> DataFrame:
    return voxel.threshold(vox, t).withColumnRenamed("fg", "v")


@stage("aircut")
def _aircut(vox: DataFrame, bins: int = 64) -> DataFrame:
    return voxel.air_cut(vox, bins)


@stage("crop")
def _crop(vox: DataFrame, low: list[int], high: list[int], stride: int = 1) -> DataFrame:
    return voxel.crop(vox, tuple(low), tuple(high), stride)


@stage("downsample")
def _downsample(vox: DataFrame) -> DataFrame:
    return voxel.downsample(vox)


@stage("normalize")
def _normalize(vox: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return voxel.percentile_normalize(vox, low, high)


@stage("blur")
def _blur(vox: DataFrame, sigma: float, shape: list[int], side: int = 64) -> DataFrame:
    return dense.gaussian_blur(vox, sigma, side, tuple(shape))


@stage("components")
def _components(vox: DataFrame, shape: list[int], full: bool = False) -> DataFrame:
    return graph.voxel_components(vox.filter("v > 0"), tuple(shape), full).withColumnRenamed("label", "v")


@stage("dilate")
def _dilate(vox: DataFrame, shape: list[int]) -> DataFrame:
    from pyspark.sql import functions as F

    return stencil.dilate(vox.filter("v > 0"), stencil.FACES, tuple(shape)).withColumn("v", F.lit(1))


def parse(text: str) -> list[tuple[str, dict]]:
    """Stages of a recipe: tables ``[[stage]]`` with a ``name`` and parameters, in order; unknown names are errors."""
    steps = []
    for table in tomllib.loads(text).get("stage", []):
        parameters = dict(table)
        name = parameters.pop("name", None)
        if name not in STAGES:
            raise KeyError(f"no stage {name}")
        steps.append((name, parameters))
    return steps


def run(text: str, vox: DataFrame) -> DataFrame:
    for name, parameters in parse(text):
        vox = STAGES[name](vox, **parameters)
    return vox
