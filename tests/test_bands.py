"""Bands against brute force, and scans that keep to the chunks of a band."""

import random

import pytest
from pyspark.sql import functions as F

from laminae.operators import bands
from laminae.sources import archive

KEY = ["z", "y", "x"]


@pytest.mark.parametrize("block, halo, reach", [(8, 0, 0), (5, 2, 3.5), (16, 4, 20)])
def test_blocks_of_a_band(spark, block, halo, reach):
    draw = random.Random(block)
    cells = [tuple(draw.uniform(-6, 40) for _ in KEY) for _ in range(12)]
    got = {tuple(r) for r in bands.band_blocks(spark.createDataFrame(cells, "z double, y double, x double"), block, halo, reach).collect()}
    want = set()
    for z in range(0, 80, block):
        for y in range(0, 80, block):
            for x in range(0, 80, block):
                k, wide = (z, y, x), halo + reach
                if any(all(b - wide <= c < b + block + wide for b, c in zip(k, cell)) for cell in cells):
                    low = [max(0, b - halo) for b in k]
                    want.add((*low, *(b + block + halo - o for b, o in zip(k, low))))
    assert got == want


def test_only_chunks_of_the_band_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "CHUNKS_A_FILE", 4)
    vox = spark.range(16 * 16 * 16).select(F.floor(F.col("id") / 256).alias("z"), (F.floor(F.col("id") / 16) % 16).alias("y"), (F.col("id") % 16).alias("x"), (F.col("id") % 251).alias("v"))
    archive.write(vox, f"{tmp_path}/a", 4)
    cells = spark.createDataFrame([(1.0, 1.0, 1.0), (14.0, 13.0, 2.0)], "z double, y double, x double")
    got = archive.read_band(spark, f"{tmp_path}/a", cells, 1.5)
    chunks = {tuple(r) for r in bands.reached(cells, 4, 1.5, ["cz", "cy", "cx"]).collect()}
    want = {tuple(r) for r in archive.read(spark, f"{tmp_path}/a").collect() if tuple(int(r[a]) // 4 for a in KEY) in chunks}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 64 * len(chunks) < 4096
    assert "PushedFilters" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "code" in plan.split("PushedFilters")[1][:400]
    assert archive.read_band(spark, f"{tmp_path}/a", cells.limit(0), 1.5).count() == 0
