"""Phase unwrapping, stitching, relaxed fields and signed graphs against dense and sequential versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from laminae.operators import fields

KEY = ["z", "y", "x"]


def rows(**arrays):
    at = np.indices(next(iter(arrays.values())).shape).reshape(3, -1)
    return pd.DataFrame(dict(zip(KEY, at, strict=True)) | {k: v.reshape(-1).astype(float) for k, v in arrays.items()})


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p.z, p.y, p.x] = p[name]
    return out


def phantom(shape, noise, seed=0):
    z, y, x = np.indices(shape)
    turns = np.hypot(y + 7.0, x + 5.0) / 6 + 0.03 * z
    return turns, np.mod(turns + np.random.default_rng(seed).normal(0, noise, shape), 1.0)


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_a_block_unwraps_up_to_one_constant(noise):
    turns, w = phantom((9, 20, 22), noise)
    u, residual = fields.unwrap_dense(w, np.ones(w.shape))
    assert residual < 1e-15
    off = w + np.round(u - (u - w).mean() - w) - turns
    whole = np.round(off.mean())
    assert np.abs(off - whole).max() < 0.5


def test_untrusted_voxels_do_not_vote():
    turns, w = phantom((8, 18, 18), 0.0)
    draw = np.random.default_rng(4)
    bad = draw.random(w.shape) < 0.1
    w = np.where(bad, draw.random(w.shape), w)
    u, _ = fields.unwrap_dense(w, np.where(bad, 0.0, 1.0))
    off = (u - turns)[~bad]
    assert np.abs(off - np.median(off)).max() < 0.2


@pytest.mark.parametrize("side", [8, 12])
def test_blocks_stitch_to_the_turns_of_the_whole(spark, side):
    shape = (10, 24, 22)
    turns, w = phantom(shape, 0.02)
    df = spark.createDataFrame(rows(w=w, trust=np.ones(shape))).withColumns({a: F.col(a).cast("long") for a in KEY})
    got = fields.wrap_numbers(df, side, 3, shape, least=60)
    u = dense(got, "u", shape)
    off = u - turns
    assert np.ptp(np.round(off - np.median(off))) == 0 and got.select("part").distinct().count() == 1
    assert np.allclose(np.mod(u - w + 0.5, 1), 0.5)


def test_loops_that_do_not_close_show_and_lone_blocks_stay(spark):
    line = [(0, 0, k) for k in range(5)]
    blocks = [(*p, b, v, 1.0) for b, v in ((1, 0.25), (2, 1.25), (3, 4.25), (9, 0.0)) for p in (line if b != 9 else [(5, 5, 5)])]
    df = spark.createDataFrame(blocks, "z long, y long, x long, block long, u double, trust double")
    offsets, loops = fields.stitch_blocks(df, least=3)
    assert {r.block: (r.root, r.offset) for r in offsets.collect()} == {1: (1, 0), 2: (1, -1), 3: (1, -4), 9: (9, 0)}
    assert {r.residual for r in loops.collect()} == {0.0}
    steps = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 3.2)]
    from laminae.operators import bridges

    left = bridges.residuals(spark.createDataFrame([(a, b, d, w) for (a, b, d), w in zip(steps, (5.0, 5.0, 1.0))], "a long, b long, d double, weight double"))
    assert {(r.a, r.b): round(r.residual, 9) for r in left.collect()} == {(1, 2): 0.0, (2, 3): 0.0, (1, 3): 1.2}


def solved(live, fixed, value, slopes):
    """Dense least squares of slopes between live voxels, fixed ones held; without any, of mean 0."""
    ids = np.full(live.shape, -1)
    ids[live] = np.arange(live.sum())
    a, b = np.zeros((live.sum(),) * 2), np.zeros(live.sum())
    for axis in range(3):
        here = tuple(slice(0, -1) if k == axis else slice(None) for k in range(3))
        there = tuple(slice(1, None) if k == axis else slice(None) for k in range(3))
        both = live[here] & live[there]
        g = ((slopes[axis][here] + slopes[axis][there]) / 2)[both]
        for i, j, d in zip(ids[here][both], ids[there][both], g):
            a[i, i] += 1
            a[j, j] += 1
            a[i, j] -= 1
            a[j, i] -= 1
            b[i] -= d
            b[j] += d
    held = fixed[live]
    out = np.full(live.shape, np.nan)
    x = np.zeros(live.sum())
    if held.any():
        x[held] = value[live][held]
        x[~held] = np.linalg.solve(a[np.ix_(~held, ~held)], b[~held] - a[np.ix_(~held, held)] @ x[held])
    else:
        x = np.linalg.lstsq(a, b, rcond=None)[0]
        x -= x.mean()
    out[live] = x
    return out


def band(seed=2, shape=(5, 9, 10)):
    z, y, x = np.indices(shape)
    return np.abs(np.hypot(y - 4, x - 4) - 3) < 1.9, np.random.default_rng(seed)


@pytest.mark.parametrize("side, levels, tolerance", [(6, 0, 1e-4), (32, 1, 1e-9)])
def test_dirichlet_field_equals_the_dense_solution(spark, side, levels, tolerance):
    live, draw = band()
    fixed = live & (draw.random(live.shape) < 0.06)
    value = draw.integers(0, 4, live.shape).astype(float)
    at = np.argwhere(live)
    domain = spark.createDataFrame(pd.DataFrame(at, columns=KEY))
    anchors = spark.createDataFrame(pd.DataFrame(np.argwhere(fixed), columns=KEY).assign(w=value[fixed]))
    got = dense(fields.dirichlet_field(anchors, domain, tolerance, side, levels), "v", live.shape)
    want = solved(live, fixed, value, [np.zeros(live.shape)] * 3)
    assert np.nanmax(np.abs(got - want)) < 10 * tolerance and (np.isnan(got) == ~live).all()


def test_eulerian_field_equals_the_dense_solution(spark):
    live, draw = band(3)
    normal = draw.standard_normal((3, *live.shape))
    p = rows(nz=normal[0], ny=normal[1], nx=normal[2])[live.reshape(-1)]
    got = dense(fields.eulerian_field(spark.createDataFrame(p), 2.0, 1e-9, 16, 1), "v", live.shape)
    want = solved(live, np.zeros(live.shape, bool), None, list(normal / 2.0))
    assert np.nanmax(np.abs(got - want)) < 1e-6


def walked(nodes, edges):
    """Strongest edge first, one after another."""
    root = {n: n for n in nodes}
    bars = set()

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b, w in sorted(edges, key=lambda e: (-abs(e[2]), min(e[:2]), max(e[:2]))):
        ra, rb = sorted((top(a), top(b)))
        if ra == rb or w == 0:
            continue
        barred = any({top(p), top(q)} == {ra, rb} for p, q in bars)
        if w < 0:
            bars.add((ra, rb))
        elif not barred:
            root[rb] = ra
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed, n, m, ties", [(1, 30, 70, False), (2, 60, 110, True), (3, 25, 200, False)])
def test_clusters_are_those_of_the_walk(spark, seed, n, m, ties):
    draw = random.Random(seed)
    nodes = [k * 3 for k in range(n + 2)]
    edges = []
    for _ in range(m):
        a, b = draw.sample(range(n), 2)
        edges.append((3 * a, 3 * b, float(draw.randrange(-4, 6)) if ties else draw.uniform(-1, 1.2)))
    unique = list({(min(a, b), max(a, b)): (a, b, w) for a, b, w in edges}.values())
    got = fields.mutex_clusters(spark.createDataFrame(unique, "a long, b long, w double"), spark.createDataFrame([(k,) for k in nodes], "id long"))
    assert {r.id: r.label for r in got.collect()} == walked(nodes, unique)
