"""Bands about surfaces: which blocks or chunks of a volume lie within reach of any cell, as equi-joins on grid numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["z", "y", "x"]


def reached(cells: DataFrame, side: int, reach: float, names: list[str]) -> DataFrame:
    """Distinct numbers of grid boxes of ``side`` whose box, wider by ``reach`` each way, holds a cell (z, y, x).

    A cell is dealt to the few boxes about it and duplicates go before the exchange; boxes before the origin do not count.
    """
    dealt = cells.select(*(F.col(a).cast("double").alias(a) for a in KEY))
    for a, c in zip(KEY, names, strict=True):
        first = F.floor((F.col(a) - side - reach) / side) + 1
        last = F.floor((F.col(a) + reach) / side)
        dealt = dealt.withColumn(c, F.explode(F.when(last >= 0, F.sequence(F.greatest(first, F.lit(0)), last)).otherwise(F.array().cast("array<bigint>"))))
    return dealt.select(*names).distinct()


def band_blocks(cells: DataFrame, block: int, halo: int, reach: float) -> DataFrame:
    """(z, y, x, dz, dy, dx): origins and sizes of blocks, with their halo, that come within ``reach`` of a valid cell."""
    numbers = [f"c{a}" for a in KEY]
    hit = reached(cells, block, halo + reach, numbers)
    origin = [F.greatest(F.col(c) * block - halo, F.lit(0)) for c in numbers]
    sizes = [F.col(c) * block + block + halo - o for c, o in zip(numbers, origin, strict=True)]
    return hit.select(*(o.alias(a) for o, a in zip(origin, KEY, strict=True)), *(s.alias(f"d{a}") for s, a in zip(sizes, KEY, strict=True)))
