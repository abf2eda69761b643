"""Nearest neighbours, periodic runs and importance resampling against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from laminae.llm import neighbours, periodic, queries, resampling

FOLDER = "/root/testdata/sf0.001"
CLASH = ["row", "n", "n_runs", "start", "length", "rank", "weight", "score", "bucket", "vector", "grp", "tab", "kind", "id", "ids", "turn", "copies", "h", "v"]


# periodic runs


def runs_of(words):
    """(start, length, smallest period) of all runs, by the definition."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > a and i - a + p >= max(24, 3 * p):
                found.setdefault((a, i - a + p), p)
            i += 1
    return sorted((a, size, p) for (a, size), p in found.items())


def row_of(words):
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = set()
    for a, size, p in runs:
        gone.update(range(a + p, a + size))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listing = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, left)]
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


def planted(doc_id, text):
    words = brute.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def mixtures(seed, count, most):
    draw = random.Random(seed)
    for _ in range(count):
        n = draw.choice([0, 5, 23, 24, 25, 60, 200, most])
        words = [draw.randrange(draw.choice([1, 2, 3, 90])) for _ in range(n)]
        for _ in range(draw.randrange(4) if n > 4 else 0):
            a = draw.randrange(n)
            p = draw.randrange(1, max(2, (n - a) // 3 + 2))
            for i in range(a, min(n, a + draw.randrange(1, 6) * p + draw.randrange(p))):
                words[i] = words[a + (i - a) % p]
        yield words


def test_z_functions_side_by_side_and_one_by_one():
    lanes = np.random.default_rng(3).integers(0, 2, (periodic.FEW_LANES + 40, 50))
    lanes[1] = 0
    for z in (periodic.z_functions(lanes), np.concatenate([periodic.z_functions(lanes[k : k + 40]) for k in range(0, len(lanes), 40)])):
        for row, own in zip(lanes.tolist(), z.tolist()):
            assert own == [next((k for k in range(50 - p) if row[k] != row[p + k]), 50 - p) for p in range(50)]


@pytest.mark.parametrize("steps, few", [(64, 64), (2, 64), (1, 0)])
def test_runs_of_all_kinds_whatever_the_tiles(spark, monkeypatch, steps, few):
    monkeypatch.setattr(periodic, "FEW_LANES", few)
    monkeypatch.setattr(periodic, "TILE_STEPS", steps)
    texts = list(mixtures(steps, 60, 700))
    fragments, row_ids = [], []
    for row, words in enumerate(texts):
        for _, lo, low, ids in periodic._tiles(np.array(words, np.uint32), np.array([0, len(words)])):
            high, step = (16, 8) if low == 1 else (2 * low, low)
            for _, p, s, e in periodic.tile_fragments([(ids, step if lo else 0)], low, high, step):
                fragments += [(row, int(a), int(b) + lo, int(c) + lo) for a, b, c in zip(p, s, e)]
        row_ids.append(row)
    found = periodic.periodic_runs(spark.createDataFrame(fragments, "row long, period long, start long, end long")).collect()
    for row, words in enumerate(texts):
        assert sorted((r.start, r.length, r.period) for r in found if r.row == row) == runs_of(words)


def test_words_are_numbered_by_bytes_not_by_hash(monkeypatch):
    from laminae.llm.grams import Piece, words_of

    data = np.frombuffer(b"ab cd ab ef cd gh gh", np.uint8)
    piece = Piece(np.array([1]), np.array([True]), data, np.array([0, len(data)]), 0)
    monkeypatch.setattr(periodic, "byte_hashes", lambda data, starts, ends, seed: np.zeros(len(starts), np.uint64))
    numbers = periodic.word_numbers(piece, words_of(piece), 0).tolist()
    assert [numbers.index(x) for x in numbers] == [0, 1, 0, 3, 1, 5, 5]


def test_periodic_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert got == {d.doc_id: row_of(planted(d.doc_id, d.text)) for d in docs}
    assert sum(r[0] > 0 for r in got.values()) >= len(docs) // 15


def test_periodic_edges(spark, tmp_path):
    loop = " ".join(f"w{k % 7}" for k in range(100))
    long = " ".join(f"x{k % 9001}" for k in range(60_000))
    rows = [(1, loop), (1, loop), (1, "a b"), (None, loop), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, "é é " * 30), (7, "the the " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in CLASH})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows)
    known = {}
    for r in got:
        known.setdefault(r.doc_id, []).append((r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli))
    assert sorted(known[1], key=str) == [(100, 1, 0, 100, 7, 14285), (100, 1, 0, 100, 7, 14285), (2, 0, None, None, None, None)]
    assert known[None] == [(100, 1, 0, 100, 7, 14285)]
    assert [known[k][0][:2] for k in (2, 3, 4)] == [(0, 0)] * 3
    assert known[5] == [(60_000, 1, 0, 60_000, 9001, 6665)]
    assert known[6] == [(60, 1, 0, 60, 1, 60_000)] and known[7] == [(22, 0, None, None, None, None)]
    assert {r.collapsed for r in got if r.doc_id is None} == {"w0 w1 w2 w3 w4 w5 w6"}
    assert periodic.find_runs(docs.limit(0)).count() == 0
    mine = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id in (2, 3, 4, 5, 6, 7)}
    texts = dict(rows[4:])
    assert {k: mine[k] for k in (2, 3, 4, 6, 7)} == {k: row_of(planted(k, texts[k])) for k in (2, 3, 4, 6, 7)}


# importance resampling

FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(text, longest):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(FOLD))
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, percent, longest, buckets, least):
    s, t = [0] * buckets, [0] * buckets
    held = [(d, *grams(x, longest)) for d, x in docs]
    for _, _, f in held:
        for x in f:
            s[zlib.crc32(x) % buckets] += 1
    for x in target:
        for g in grams(x, longest)[1]:
            t[zlib.crc32(g) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    out, able = [], []
    for d, words, f in held:
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_importance_resampling(spark, FOLDER).collect()), key=str)
    assert got == resampled(docs, target, 10, 1, 10000, 20)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 50])
def test_resampling_by_trigrams_and_edges(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(resampling, "SLICE_BYTES", slice_bytes)
    text = "The cat, the dog; THE cat's 12th naïve Über-house\x7f\x85of\nthe\x00man"
    rows = [(1, text), (2, None), (3, ""), (4, "?! ,."), (5, text * 3), (5, text * 3), (None, text), (None, text), (6, "a " * 30_000), (7, "É é ÉÉ aaa"), (8, text + " x")]
    rows += [(k, text) for k in range(20, 60)]
    target = ["the cat and the naïve house", None, "", "a a a"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in CLASH}).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, wanted, 40, 3, 997, 5).collect()), key=str)
    assert got == resampled(rows, target, 40, 3, 997, 5)
    assert resampling.resample(docs.limit(0), wanted).count() == 0
    assert resampling.resample(docs, wanted.limit(0), 40, 2, 50, 5).count() == len(rows)


# nearest neighbours


def best(rows, k, queried):
    """query -> [(id, score)], by brute force over vectors that take part."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return {q: [(i, s) for s, i in sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:k]] for q in good if queried(q)}


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, -r.score))
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-3.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, math.nan]), (7, [math.inf, 1.0]), (8, []), (None, [5.0, 5.0]), (9, [100.0, 0.5]), (40, [-0.0, 1.0]), (41, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("?") for c in CLASH}).repartition(3)
    got = lists(neighbours.nearest(df, k=3))
    assert got == best(rows, 3, lambda q: q % 20 == 0)
    assert len(lists(neighbours.nearest(df, k=20))[0]) == 6
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0")).count() == 0


def test_copies_are_ranked_by_id_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_PROBES", 8)
    draw = np.random.default_rng(5)
    other = draw.standard_normal((300, 8)).astype(np.float32).tolist()
    rows = [(k, [1.0] * 8) for k in range(400)] + [(1000 + k, v) for k, v in enumerate(other)]
    rows.append((1000, other[0]))  # a repeated row
    got = lists(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), k=20))
    want = best(rows, 20, lambda q: q % 20 == 0)
    assert {q: got[q] for q in got if q < 1000} == {q: want[q] for q in want if q < 1000}
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("blocks", [8192, 64])
def test_recall_on_given_and_uneven_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", blocks)
    monkeypatch.setattr(neighbours, "BLOCK_PROBES", blocks)
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    draw = np.random.default_rng(6)
    lengths = draw.uniform(0.5, 1.5, (1500, 1))
    uneven = list(enumerate((draw.standard_normal((1500, 24)) * lengths).tolist()))
    for rows, kind in ((given, "float"), (uneven, "double")):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
        got = lists(neighbours.nearest(df))
        want = best([(i, np.float32(v).astype(float).tolist() if kind == "float" else v) for i, v in rows], 20, lambda q: q % 20 == 0)
        assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
        known = {q: dict(x) for q, x in best([(i, np.float32(v).astype(float).tolist() if kind == "float" else v) for i, v in rows], len(rows), lambda q: q % 20 == 0).items()}
        assert all(known[q][i] == s for q in got for i, s in got[q])
