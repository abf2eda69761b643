"""Median filters over tiles of frames against plain walks."""

import random

import pytest

from laminae.operators import frames


@pytest.fixture(scope="module")
def cells():
    draw = random.Random(5)
    return {(m, u, v): draw.choice((draw.randrange(20), draw.randrange(100))) for m in ("a", "b") for u in range(-5, 9) for v in range(7) if draw.random() < 0.7}


def near(cells, place, reach):
    m, u, v = place
    return [cells[q] for du in range(-reach, reach + 1) for dv in range(-reach, reach + 1) if (q := (m, u + du, v + dv)) in cells]


def kept(cells):
    out = {}
    for place, d in cells.items():
        around = sorted(near(cells, place, 2))
        if len(around) < 5 or abs(d - around[len(around) // 2]) <= 15:
            out[place] = d
    return out


def test_outliers_go_across_tiles(spark, cells, monkeypatch):
    monkeypatch.setattr(frames, "_around", None)  # no copy of a cell for every neighbour
    df = spark.createDataFrame([(*p, d, "kept as it is") for p, d in cells.items()], "mesh string, u int, v int, d int, note string")
    out = frames.reject_outliers(df, "d", 15, side=4)
    assert out.dtypes == df.dtypes
    assert {(r.mesh, r.u, r.v): r.d for r in out.collect()} == kept(cells)


def test_means_of_kept_cells_across_tiles(spark, cells, monkeypatch):
    monkeypatch.setattr(frames, "_around", None)
    df = spark.createDataFrame([(*p, d) for p, d in cells.items()], "mesh string, u int, v int, d int")
    good = kept(cells)
    want = {p: sum(n) / len(n) for p in cells if (n := near(good, p, 1))}
    assert {(r.mesh, r.u, r.v): r.d for r in frames.smooth_kept(df, "d", 15, side=4).collect()} == {p: pytest.approx(d) for p, d in want.items()}
