"""Ids of every size, repeated and null, for the operators that tell rows with one id apart."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from laminae.llm import common, ngram_join, substring_dedup

TEXT = " ".join(f"w{k}" for k in range(40))
OTHER = " ".join(f"v{k}" for k in range(40))
NULLS = 1000


@pytest.fixture(scope="module", params=[(2**62 + 5, -(2**63), 2**63 - 1), (12, -5, 2**40)])
def rows(request):
    a, least, most = request.param
    draw = random.Random(4)
    words = TEXT.split()
    rows = [(a, TEXT), (a, OTHER), (7, TEXT), (least, OTHER + " x"), (most, TEXT + " y"), (most, " ".join(words[:30])), (most, "short one")]
    rows += [(k, " ".join(draw.sample(words, 20) + words)) for k in (100, 101, 101, 102)]
    return rows + [(None, TEXT)] * NULLS


def test_links_and_components(spark, rows):
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4, percent=60).collect()
    known = [(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None]
    named = [r for r in rows if r[0] is not None]
    sets = [brute.shingles(t, 4) for _, t in named]
    root = list(range(len(named)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 60 * len(x | y):
                root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(named):
        least[top(k)] = min(d, least.get(top(k), d))
    assert sorted(known) == sorted((d, len(s), least[top(k)]) for k, ((d, _), s) in enumerate(zip(named, sets)))
    assert sum(r.doc_id is None for r in got) == NULLS


def test_removed_words(spark, rows):
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    first = {}
    for d, t in rows:
        words = t.split()
        for k in range(len(words) - 12) if d is not None else ():
            w = tuple(words[k : k + 13])
            first[w] = min(d, first.get(w, d))
    want = []
    for d, t in rows:
        words = t.split()
        gone = [False] * len(words)
        for k in range(len(words) - 12) if d is not None else ():
            if first[tuple(words[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        want.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == sorted(want, key=str)


def test_rows_without_id_are_dealt_to_all_tasks(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keyed = common.keyed(df, "doc_id", "key")[0]
    parts = keyed.filter("key is null").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == NULLS and max(r["count"] for r in parts) < NULLS / 2
    keys = [r.key for r in keyed.filter("key is not null").collect()]
    assert len(set(keys)) == len(keys) == len(rows) - NULLS
