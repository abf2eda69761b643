import random

import brute
import pytest

from laminae.llm import ngram_join


def _family(seed):
    """Documents around a few bases, edited more and more, with copies, and texts that share one line."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = "this line is in very many of the documents here"
    rows, at = [], 0
    for base in range(4):
        text = [rng.choice(words) for _ in range(rng.choice((12, 60, 150)))]
        for k in range(40):
            own = list(text)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own += line.split()
            if rng.random() < 0.2:
                own = own[rng.randrange(4) :]
            at += rng.randrange(1, 3)
            rows.append((at, " ".join(own)))
    rows += [(900 + k, f"{line} {k} {k + 1} alpha{k}") for k in range(60)]
    rows += [(1000, ""), (1001, None), (1002, "one"), (1003, "ONE"), (1004, "  \n"), (1005, "a b"), (1006, "A b")]
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_matches_brute_force(spark, seed, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 4096)
    rows = _family(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, width, percent).collect()}
    assert got == brute.near(rows, width, percent)


def test_edge_rows(spark):
    rows = [(5, "x y z v", 1), (5, "x y z v", 2), (None, "x y z v", 3), (7, "x Y z V", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect())
    assert got == [(0, 1, None), (5, 1, 5), (5, 1, 5), (7, 1, 5)]
    assert ngram_join.near_duplicates(docs.limit(0), 4, 85).count() == 0
