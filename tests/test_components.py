"""Chunk-local components against a plain flood fill, and offsets along long chains."""

import random

import pytest

from laminae.operators import graph, selection
from laminae.operators.stencil import AROUND, FACES


def flood(mask, shape, offsets):
    left, out = set(mask), {}
    for start in sorted(mask):
        if start not in left:
            continue
        label = (start[0] * shape[1] + start[1]) * shape[2] + start[2]
        stack = [start]
        left.discard(start)
        while stack:
            p = stack.pop()
            out[p] = label
            for o in offsets:
                q = tuple(a + b for a, b in zip(p, o))
                if q in left:
                    left.discard(q)
                    stack.append(q)
    return out


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("side", [1, 4, 5, 64])
def test_components_do_not_depend_on_chunks(spark, full, side):
    draw, shape = random.Random(side), (11, 9, 14)
    mask = [(z, y, x) for z in range(11) for y in range(9) for x in range(14) if draw.random() < (0.2 if full else 0.42)]
    mask += [p for p in [(0, 0, x) for x in range(14)] + [(z, 0, 13) for z in range(11)] if p not in mask]
    rows = graph.voxel_components(spark.createDataFrame(mask, "z int, y int, x int"), shape, full, side).collect()
    assert {(r.z, r.y, r.x): r.label for r in rows} == flood(mask, shape, AROUND if full else FACES)
    assert len(rows) == len(mask)


def test_no_voxels_no_components(spark):
    assert graph.voxel_components(spark.createDataFrame([], "z int, y int, x int"), (4, 4, 4)).count() == 0


def test_offsets_of_a_chain_take_few_rounds(spark, monkeypatch):
    n, draw = 300, random.Random(1)
    names = draw.sample(range(10_000), n)
    steps = [draw.randrange(-3, 4) for _ in range(n - 1)]
    edges = [(names[k], names[k + 1], steps[k]) if draw.random() < 0.5 else (names[k + 1], names[k], -steps[k]) for k in range(n - 1)]
    df = spark.createDataFrame([*edges, (20_001, 20_000, 5)], "a long, b long, step long")
    taken, own = [], selection.settled
    monkeypatch.setattr(selection, "settled", lambda d: taken.append(1) or own(d))
    got = {r.id: (r.root, r.offset) for r in selection.tree_offsets(df).collect()}
    value, at = {names[0]: 0}, 0
    for k, s in enumerate(steps):
        at += s
        value[names[k + 1]] = at
    root = min(names)
    assert got == {i: (root, v - value[root]) for i, v in value.items()} | {20_000: (20_000, 0), 20_001: (20_000, -5)}
    assert len(taken) < 120


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, states, settled = 150, [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: states.append(1) or settled(df))
    edges = spark.createDataFrame([*((k + 1, k) for k in range(n - 1)), (20_000, 30_000)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(n), 20_000, 40_000]], "id long")
    got = {r.id: r.label for r in graph.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 20_000: 20_000, 40_000: 40_000}
    assert len(states) < 20
