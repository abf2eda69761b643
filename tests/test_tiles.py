"""Morphology tile by tile against joins over the whole volume."""

import numpy as np

from laminae.operators import stencil


def test_closing_across_tiles_and_at_the_ends(spark, monkeypatch):
    draw = np.random.default_rng(8)
    shape, ball = (11, 9, 10), stencil.ball(2)
    at = np.argwhere(draw.random(shape) < 0.25).tolist()
    df = spark.createDataFrame(at, "z long, y long, x long")
    want = {tuple(r) for r in stencil.erode(stencil.dilate(df, ball, shape), ball).collect()}
    monkeypatch.setattr(stencil, "shifted", None)  # no copy of a voxel for every offset
    rows = [tuple(r) for r in stencil.close(df, ball, shape, side=4).collect()]
    assert set(rows) == want and len(rows) == len(want) > 0


def test_euler_number_counts_each_part_once(spark, monkeypatch):
    draw = np.random.default_rng(10)
    at = (np.argwhere(draw.random((9, 8, 10)) < 0.4) - 3).tolist()
    parts = {tuple(2 * c + 1 + d for c, d in zip(p, o)) for p in at for o in stencil.CUBE}
    counts = [sum(sum(c % 2 for c in p) == k for p in parts) for k in range(4)]
    monkeypatch.setattr(stencil, "shifted", None)  # no copy of a voxel for every part
    row = stencil.euler(spark.createDataFrame(at, "z long, y long, x long"), side=4).first()
    assert tuple(row) == (*counts, counts[0] - counts[1] + counts[2] - counts[3])
