"""Best-fit packing: rounds whatever the sizes, and sequences against plain best-fit decreasing."""

import random
from bisect import bisect_left, insort

import pytest

from laminae.llm import packing


def plain(sizes, capacity):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect_left(gaps, size)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        opened += gap == capacity
        if gap > size:
            insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("low, high", [(1, 20), (1, 64), (1, 1023), (300, 400)])
def test_rounds_and_sequences(spark, monkeypatch, low, high):
    draw = random.Random(high)
    sizes = [draw.randint(low, high) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    taken, own = [], type(items).checkpoint
    monkeypatch.setattr(type(items), "checkpoint", lambda df, *a, **k: taken.append(1) or own(df, *a, **k))
    bins = {}
    for r in packing.best_fit(items, 1024).collect():
        bins.setdefault(r.bin, []).append((r.offset, sizes[r.uid]))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 1024
    assert sum(map(len, bins.values())) == len(sizes)
    assert len(bins) <= 1.01 * plain(sizes, 1024)
    assert len(taken) <= 16


@pytest.mark.parametrize("low, high", [(1, 20), (1, 1024), (300, 400)])
def test_one_pass_over_many_ranges_is_plain_best_fit(spark, monkeypatch, low, high):
    draw = random.Random(low)
    sizes = [draw.randint(low, high) for _ in range(4000)]
    monkeypatch.setattr(packing, "SWEEP_ROWS", 19)  # 211 ranges
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    taken, own = [], type(items).checkpoint
    monkeypatch.setattr(type(items), "checkpoint", lambda df, *a, **k: taken.append(1) or own(df, *a, **k))
    bins = {}
    for r in packing.best_fit(items, 1024).collect():
        bins.setdefault(r.bin, []).append((r.offset, r.uid))
    for held in bins.values():
        ends = [offset + sizes[uid] for offset, uid in sorted(held)]
        assert [offset for offset, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert sorted(uid for held in bins.values() for _, uid in held) == list(range(len(sizes)))
    assert len(bins) == plain(sizes, 1024)
    assert len(taken) == 1
