"""Texts and settings under which hashes collide, ids repeat, or data outgrow one exchange."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laminae.llm import bpe, exact_dedup, grams, mlm, ngram_join, packing, quality, substring_dedup, token_files, tokens


def _thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


ONE, OTHER = _thue_morse(1024, "a", "b"), _thue_morse(1024, "b", "a")
TWINS = [(1, " ".join([ONE] * 13)), (2, " ".join([OTHER] * 13)), (3, f"{ONE} {OTHER} end"), (4, f"{OTHER} {ONE} end")]


def _eight_bits(data, starts, ends, seed=0):
    return grams.byte_hashes(data, starts, ends, seed) & np.uint64(0xFF << 56)


def test_words_that_collide_in_polynomial_hashes(spark):
    docs = spark.createDataFrame(TWINS, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(TWINS)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert near == brute.near(TWINS)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(bytes(rows[k].decoded).decode() == t for k, t in TWINS)
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in TWINS}
    assert {r.doc_id: r.ids_crc32 for r in token_files.round_trip(docs).collect()} == want


def test_cache_under_eight_bit_hashes(monkeypatch):
    monkeypatch.setattr(tokens, "byte_hashes", _eight_bits)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(900)) for _ in range(80)) for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": texts})
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    cache = tokens.ChunkCache(lambda some: [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)])
    for piece in grams.pieces(batch, "doc_id", "text", 3000):
        ids, counts = cache.ids_of(piece)
        own = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in own] == [tokenizer.encode(texts[k], add_special_tokens=False).ids for k in piece.ids]


def test_global_words_under_eight_bit_hashes(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "byte_hashes", _eight_bits)
    monkeypatch.setattr(tokens, "byte_hashes", _eight_bits)
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('xyz')}{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(bpe, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    path = tokens.vocabulary_path(bpe.MULTI_VOCABULARY)
    blocks = list(bpe._pack([batch]))
    words = list(bpe._distinct(4)(blocks))
    ids = pa.Table.from_batches(bpe._encode(path)(words))
    out = bpe._reassemble(np.uint16)(pa.Table.from_batches(blocks), ids).to_pylist()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in out} == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_decode_of_nulls(spark):
    rows = spark.createDataFrame([(1, 0, b""), (2, None, None)], "doc_id long, n_tokens long, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows).collect()} == {1: b"", 2: None}


def _passages(seed):
    rng = random.Random(seed)
    line = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 90))) + (f" {line} t{k}" if rng.random() < 0.6 else "")) for k in range(60)]
    return [*rows, *((100 + k, rows[k % 7][1]) for k in range(40)), (200, None), (201, "")]


def test_more_ranges_than_one_exchange_deals_to(spark, monkeypatch):
    for module in (substring_dedup, ngram_join):
        monkeypatch.setattr(module, "BUCKET_BYTES", 300)
    monkeypatch.setattr(grams, "FAN", 8)
    rows = _passages(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(rows)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert near == brute.near(rows)


def test_a_block_sends_rows_in_proportion(monkeypatch):
    """However many ranges the corpus needs, a row carries many windows."""
    monkeypatch.setattr(grams, "FAN", 64)
    assert grams.levels(100_000) == [64, 64 * 64] and grams.levels(64) == [64]
    text = " ".join(f"u{k}" for k in range(30_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    counts = []
    for groups in (64, 100_000):
        first = grams.levels(groups)[0]
        counts.append(sum(b.num_rows for b in substring_dedup._scan(13, 0, first, 1)([batch])))
    assert counts[0] == counts[1] <= 64


def test_rows_of_one_id_keep_their_own_words(spark):
    line = " ".join(f"a{k}" for k in range(20))
    rows = [(5, f"{line} q " + "x y z " * 3, "first"), (5, "other words of the tail " + line, "second"), (5, "b " * 30, "third"), (3, line, "small"), (None, line, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)
    got = {r.kept_text for r in substring_dedup.remove_repeats(docs).collect() if r.doc_id == 5}
    assert got == {"q " + " ".join(["x y z"] * 3), "other words of the tail", " ".join(["b"] * 30)}
    cut = {r.name: r.text for r in substring_dedup.cut_documents(docs).collect()}
    assert cut["second"] == "other words of the tail" and cut["none"] == line and cut["third"] == "b " * 30
    sizes = sorted((r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect() if r.doc_id == 5)
    assert len(sizes) == 3 and all(c == 5 for _, c in sizes)


@pytest.mark.parametrize(("sent", "share"), [(2_000_000, 1000), (0, 1000), (2_000_000, 3), (0, 1)])
def test_exact_dedup_ways(spark, monkeypatch, sent, share):
    monkeypatch.setattr(exact_dedup, "SENT_FINGERPRINTS", sent)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = [(k, f"text {k % 37 if k % 3 else 0}") for k in range(300)] + [(400, None), (401, ""), (None, "text 0"), (7, "text 7")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    members = {}
    for d, t in rows:
        members.setdefault(t or "", []).append(d)
    want = {hashlib.sha256(t.encode()).hexdigest(): (max(d for d in ids if d is not None), len(ids)) for t, ids in members.items()}
    assert len(got) == len(rows) and all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(top for top, _ in want.values())


@pytest.mark.parametrize("ranges", [100_000, 250])
@pytest.mark.parametrize("mix", ["uniform", "small", "lognormal", "documents", "ties"])
def test_packing_is_best_fit(spark, monkeypatch, mix, ranges):
    monkeypatch.setattr(packing, "SWEEP_ROWS", ranges)
    rng = np.random.default_rng(11)
    sizes = {
        "uniform": lambda: rng.integers(150, 401, 2000),
        "small": lambda: rng.integers(1, 513, 2000),
        "lognormal": lambda: np.clip(rng.lognormal(5, 1, 2000).astype(int), 1, 1023),
        "documents": lambda: np.array([1 + (r[0] or 0) // 4 % 1023 for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.length("text")).collect()]),
        "ties": lambda: rng.choice([100, 250, 341, 342, 500, 512, 700], 2000),
    }[mix]().tolist()
    placed = packing.best_fit(spark.createDataFrame(list(enumerate(sizes)), "uid long, length long").repartition(3), 1024).collect()
    bins = {}
    for r in placed:
        bins.setdefault(r.bin, []).append((r.offset, sizes[r.uid]))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(placed) == len(sizes) and len(bins) <= 1.01 * len(brute.best_fit_decreasing(sizes, 1024)) + 1


def test_masked_lm_gradient():
    """A step of training goes down the slope that finite differences measure."""
    rng = np.random.default_rng(3)
    some, around = rng.integers(0, mlm.TOKENS, 40), rng.integers(0, mlm.TOKENS + 1, (4, 40))
    net = mlm.Network(*(p.astype(np.float64) for p in mlm.Network.fresh()))
    loss = lambda n: -mlm.log_probabilities(n, some, around).mean()
    after, squares = mlm.Network(*(p.copy() for p in net)), mlm.Network(*(np.full_like(p, 1e12) for p in net))
    mlm.train_batch(after, squares, some, around)  # with huge squares, a step is the gradient times RATE / 1e6
    for part, moved, own in zip(net, after, range(6)):
        step = (part - moved) * 1e6 / mlm.RATE
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        high, low = (mlm.Network(*(p.copy() for p in net)) for _ in range(2))
        high[own][at] += 1e-4
        low[own][at] -= 1e-4
        assert step[at] == pytest.approx((loss(high) - loss(low)) / 2e-4, rel=1e-3)


def test_masked_lm_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, test = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    words = mlm.vocabulary(mlm.word_counts(train))
    net = mlm.train(mlm.tokenised(train, words))
    flat = lambda df: np.concatenate([np.frombuffer(r.tokens, "<u2") for r in mlm.tokenised(df, words).collect()]).astype(int)
    own, counts = flat(test), np.bincount(flat(train), minlength=mlm.TOKENS) + 1.0
    unigram = np.log(counts / counts.sum())[own].mean()
    rows = [r.tokens for r in mlm.tokenised(test, words).collect()]
    scores = np.concatenate([mlm.log_probabilities(net, t, mlm.neighbours(t, np.array([0, len(t)]))) for t in (np.frombuffer(x, "<u2").astype(int) for x in rows)])
    assert scores.mean() > unigram


def test_site_posteriors_match_brute_force(spark):
    rows = [(k, f"text number {k} " * (1 + k % 5), f"h{k % 3}", f"p{k % 7}") for k in range(120)]
    labels = [(k, int(k % 3 == 0 or k % 7 == 1)) for k in range(0, 120, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").repartition(3)
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), host="host", path="path").collect()}
    mark = dict(labels)
    y = {k: (float(mark[k]), 1.0) if k in mark else (quality.SOFT / (1 + np.exp(-got[k].evidence)), quality.SOFT) for k in got}
    total = lambda ids: (sum(y[k][0] for k in ids), sum(y[k][1] for k in ids))
    site = {k: (h, p) for k, _, h, p in rows}
    hosts = {h: total([k for k in site if site[k][0] == h]) for h, _ in site.values()}
    paths = {s: total([k for k in site if site[k] == s]) for s in site.values()}
    good, n = total(site)
    prior = good / n

    def strength(groups):
        spread = sum(m * (g / m - p) ** 2 for g, m, p in groups)
        chance = sum(p * (1 - p) for _, _, p in groups)
        between = max((spread - chance) / sum(m for _, m, _ in groups), 1e-6)
        return min(max(np.mean([p * (1 - p) for _, _, p in groups]) / between - 1, 1.0), 1e4)

    of_host = strength([(g, m, prior) for g, m in hosts.values()])
    share = {h: (g + of_host * prior) / (m + of_host) for h, (g, m) in hosts.items()}
    of_path = strength([(g, m, share[s[0]]) for s, (g, m) in paths.items()])
    for k, s in site.items():
        host = (hosts[s[0]][0] - y[k][0] + of_host * prior) / (hosts[s[0]][1] - y[k][1] + of_host)
        path = (paths[s][0] - y[k][0] + of_path * host) / (paths[s][1] - y[k][1] + of_path)
        assert got[k].host_posterior == pytest.approx(host, abs=1e-6) and got[k].path_posterior == pytest.approx(path, abs=1e-6)
