"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import base64
import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laminae.llm import bpe, components, exact_dedup, langid, mlm, packing, quality, substring_dedup, token_files, webp
from laminae.llm.tokens import vocabulary_path

LONG = " ".join(f"word{k % 7001}" for k in range(60_000))
ROWS = [
    (1, "the cat and the dog went to the house of the man", "en"),
    (2, "der Hund und die Katze gehen in das Haus des Mannes", "de"),
    (3, "", "en"),
    (4, None, None),
    (5, "the cat and the dog went to the house of the man", "en"),
    (5, "the cat and the dog went to the house of the man", "en"),
    (None, "the cat and the dog went to the house of the man", "en"),
    (None, "only here      x\u0085y  \n\n z's 12,3 \x1c  <|endoftext|>", None),
    (6, LONG, "en"),
    (7, "123 456 !!", None),
    (8, "\n \t ", "de"),
    (9, "é" * 3 + " \U0001f600 über naïve", "de"),
]
#: Columns of results, as columns of the input with other contents.
CLASH = ["score", "component_id", "fp", "n", "top", "sha", "kept", "starts", "ends", "uid", "bin", "offset", "samples", "media", "host", "path", "good", "evidence", "w", "y", "ids", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({c: F.lit("?") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_language(spark, docs, none):
    rows = langid.identify(docs, docs.filter(~langid.held_out())).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].ambiguous for k in (3, 4, 7, 8))
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none, docs).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.identify(docs, docs.filter("lang = 'de'")).collect()
    assert {r.lang_pred for r in one} == {"und", "de"}


def test_language_codes_and_ambiguity():
    for n in (1, 2, 3, 4, 6, 7, 20):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes}) == n
        if n > 1:
            assert ((codes > 0).any(0) & (codes < 0).any(0)).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, docs.filter(~langid.held_out())).alias("p").join(docs.alias("d"), "doc_id").filter(langid.held_out())
    right, n = out.agg(F.avg((F.col("p.lang_pred") == F.col("d.lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_exact(docs, none):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    cat = [r for r in rows if r.text_sha256 == hashlib.sha256(ROWS[0][1].encode()).hexdigest()]
    assert len(cat) == 4 + 0 and all((r.keep_id, r.group_size) == (5, 4) for r in cat)
    assert sorted((r.doc_id or 0, r.kept) for r in cat) == [(0, False), (1, False), (5, False), (5, True)]
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert all((r.keep_id, r.group_size) == (4, 2) for r in empty) and {r.doc_id for r in empty if r.kept} == {4}
    assert exact_dedup.exact_duplicates(none).count() == 0


@pytest.mark.parametrize("bits", [64, 61, 40, 12])
def test_quotient_filters_merge_losslessly(bits):
    rng = np.random.default_rng(bits)
    all_rows = rng.integers(0, 1 << min(bits, 10), 4000).astype(np.uint64) << np.uint64(max(0, bits - 10))
    parts = [exact_dedup.CountingQuotientFilter.build(p, bits) for p in np.array_split(all_rows, 7)]
    back = [exact_dedup.CountingQuotientFilter.from_bytes(p.to_bytes()) for p in parts]
    merged = exact_dedup.CountingQuotientFilter.merge(back)
    values, counts = np.unique(all_rows, return_counts=True)
    assert (merged.values == values).all() and (merged.counts == counts).all()
    assert (merged.count(values) == counts).all() and merged.to_bytes() == exact_dedup.CountingQuotientFilter.build(all_rows, bits).to_bytes()
    assert merged.count(np.array([3], np.uint64))[0] == counts[values == 3].sum()


def test_substrings(spark, docs, none):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"a b {passage} c"), (2, f"{passage} {passage}"), (3, f"x {passage[:-4]} y " + " ".join("q" * 20)), (4, passage + "\n"), (5, None), (6, ""), (7, "q q q q q q q q q q q q q q q")]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.repeats(rows)
    out = substring_dedup.remove_repeats(docs)
    assert out.count() == len(ROWS) and substring_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.cut_documents(docs).schema == docs.schema


def test_token_files(docs, none):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    rows = token_files.round_trip(docs).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)][:2] == [None, None]
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t, _ in ROWS)
    assert sorted(r.ids_crc32 for r in rows) == want
    assert token_files.round_trip(none).count() == 0


def test_number_coding():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_files.decode_numbers(*token_files.encode_numbers(numbers), n) == numbers).all()


def test_bpe(docs, none):
    import public_tokenizers

    path = vocabulary_path(bpe.MULTI_VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs)).collect()
    want = sorted(np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for _, t, _ in ROWS)
    assert sorted(bytes(r.ids) for r in rows) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, _ in ROWS)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 for v in by.values())
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and sum(r.doc_id is None for r in rows) == 2
    assert packing.pack(none).count() == 0


def test_packing_of_few_rows_is_best_fit(spark):
    def bins(sizes, capacity):
        items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long").repartition(3)
        used = {}
        for r in packing.best_fit(items, capacity).collect():
            used.setdefault(r.bin, []).append((r.offset, sizes[r.uid]))
        for spans in map(sorted, used.values()):
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, [*spans[1:], (capacity, 0)], strict=True))
        assert sum(map(len, used.values())) == len(sizes)
        return len(used)

    assert bins([400, 400, 200], 1000) == 1
    sizes = (np.random.default_rng(4).gamma(2, 120, 1500).astype(int) % 1023 + 1).tolist()
    assert bins(sizes, 1024) == len(brute.best_fit_decreasing(sizes, 1024))


def test_media(docs, none):
    rows = webp.from_media(webp.to_media(docs)).collect()
    assert len(rows) == len(ROWS)
    want = sorted(webp.padded((t or "").encode()).tobytes() for _, t, _ in ROWS)
    assert sorted(bytes(r.samples) for r in rows) == want
    assert webp.from_media(webp.to_media(none)).count() == 0


@pytest.mark.parametrize("how", [{}, {"modes": list(range(14))}, {"modes": [11, 12, 13], "cross": [0x123456, 0xFE01F0], "subtract_green": True, "cache_bits": 6, "tile_bits": 2}, {"palette": True}, {"palette": True, "modes": [1, 2], "cache_bits": 2}, {"cache_bits": 3, "references": False}])
def test_webp_features(how):
    rng = np.random.default_rng(7)
    levels = 2 if how.get("palette") else 256
    image = (rng.integers(0, levels, (19, 23, 4)) * (255 // (levels - 1))).astype(np.uint8)
    image[4:9] = image[3]
    image[12, 5:15] = image[12, 4]
    assert (webp.decode(webp.encode(image, **how)) == image).all()


def test_webp_grey_is_lossless_webp():
    for text in (b"", b"a", b"\xff" * 576, b"ab" * 400, bytes(range(256)) * 3, LONG.encode()[:5000]):
        samples = webp.padded(text)
        data = webp.encode_grey(samples)
        image = webp.decode(data)
        assert (image[..., 1].reshape(-1) == samples).all() and (image[..., 0] == image[..., 2]).all()
        assert (webp.decode_grey([data])[0] == samples).all()


def test_media_of_a_text_that_no_single_image_holds(monkeypatch):
    assert [len(part) // webp.ROW for part in webp.images_of(np.zeros(16_411 * webp.ROW, np.uint8))] == [16_384, 27]
    monkeypatch.setattr(webp, "SIDE", webp.ROW)  # smaller images: 577 rows stand for 16,411
    text = "many rows " * (577 * webp.ROW // 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, "short"]})
    rows = [r for out in webp._load(webp._store([batch])) for r in out.to_pylist()]
    assert [len(webp.files_of(r["media"])) for r in rows] == [2, 1]
    assert [r["samples"] for r in rows] == [webp.padded(t.encode()).tobytes() for t in (text, "short")]


def test_masked_lm(docs, none):
    rows = mlm.pseudo_likelihood(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[3].n_tokens, by[3].pll, by[3].mean_logprob) == (0, 0, None)
    assert by[1].pll == pytest.approx(by[5].pll) and by[6].n_tokens == 60_000 and by[6].pll < 0
    assert mlm.pseudo_likelihood(none).count() == 0


def test_masked_lm_probabilities_sum_to_one():
    net = mlm.Network.fresh()
    around = np.repeat(np.array([[3], [mlm.TOKENS], [5], [7]]), mlm.TOKENS, axis=1)
    assert np.exp(mlm.log_probabilities(net, np.arange(mlm.TOKENS), around)).sum() == pytest.approx(1, abs=1e-3)


def test_masked_lm_trains_every_position():
    for n in (0, 1, 7, 100):
        assert sorted(np.concatenate([mlm.trained_positions(turn, n) for turn in range(mlm.ROUNDS)]).tolist()) == list(range(n))


def test_masked_lm_tells_words_of_a_shared_id_apart(spark):
    docs = spark.createDataFrame([(1, "alphaing"), (2, "betaing"), (3, "Betaing"), (4, "betaing"), (5, "")], "doc_id long, text string").repartition(3)
    model = (mlm.Network.fresh(), mlm.Vocabulary(np.zeros(0, np.uint64)))
    pll = {r.doc_id: r.pll for r in mlm.pseudo_likelihood(docs, model).collect()}
    assert pll[2] == pll[3] == pll[4] and pll[5] == 0
    assert pll[2] - pll[1] == pytest.approx(np.log(3), abs=1e-6)


def test_masked_lm_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = mlm.vocabulary(mlm.word_counts(docs.select("doc_id", "text")))
    net = mlm.train(mlm.tokenised(docs.select("doc_id", "text"), words))
    after = mlm.pseudo_likelihood(docs, (net, words)).agg(F.sum("pll") / F.sum("n_tokens")).first()[0]
    before = mlm.pseudo_likelihood(docs, (mlm.Network.fresh(), words)).agg(F.sum("pll") / F.sum("n_tokens")).first()[0]
    assert after > before + 0.3


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "?"), (1, 0, "?"), (2, 0, "?"), (None, 1, "?"), (6, None, "?"), (99, 1, "?")], "doc_id long, quality int, text string")
    rows = quality.score(docs, labels, host="lang").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.quality <= 1 for r in rows)
    assert quality.score(none, labels, host="lang").count() == 0
    bare = quality.score(docs, labels.limit(0), host="lang", path="doc_id").collect()
    assert all(r.keep for r in bare)


def test_quality_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels.filter(~langid.held_out()), host="source", path="lang").alias("q").join(labels.alias("l"), "doc_id").filter(langid.held_out())
    assert out.agg(F.avg((F.col("q.keep").cast("int") == F.col("l.quality")).cast("int"))).first()[0] > 0.93


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 300), (300, 400), (7, 7), (None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 300: 300, 400: 300, 500: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
