"""Importance resampling towards a target distribution, by hashed n-grams.

Texts become words by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. Shifted dictionary indices form the n-grams; of each batch, distinct ones alone are hashed by
CRC-32. Two scans read the texts: the first sums features by bucket, in tasks and then in Spark; between them, a row a
bucket gives each bucket's gain, the only thing that is broadcast (``buckets`` numbers); the second takes the gains of a
text's features and sums them over segments. Ranks come from sums over ranges of scores, not from one sorted task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.session import running_sums

from .common import prepare, stored
from .grams import ragged

#: Fixed value: what lies between words, after A-Z have become a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that the kernels get at a time; one longer text goes alone.
SLICE_BYTES = 8 << 20


def _slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    upto = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        before = upto[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
        yield row, stop
        row = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after another, n+1 cut points); a null text has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN_WORDS)
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = pc.list_flatten(lists)
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))  # the ends of a text may leave an empty string
    upto = np.append(0, np.cumsum(some))
    return flat.filter(pa.array(some)), upto[np.append(0, np.cumsum(counts))]


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, the text that has it, words of each text): all runs of 1 to ``longest`` words."""
    words, cuts = _words(texts)
    coded = words.dictionary_encode()
    terms = [w.encode() for w in coded.dictionary.to_pylist()]
    own = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))  # running hash of each distinct n-gram
    index = np.asarray(coded.indices).astype(np.int64)
    first, sizes = cuts[:-1], np.diff(cuts)
    grams = index
    found = [own[grams] % buckets]
    owner = [np.repeat(np.arange(len(sizes)), sizes)]
    for n in range(2, longest + 1):
        # a gram one word longer: the gram at a place and the word n - 1 places on, inside one text
        has = np.maximum(sizes - n + 1, 0)
        before = np.maximum(sizes - n + 2, 0)
        head = ragged(np.cumsum(before) - before, has)
        pair = grams[head] * len(terms) + index[ragged(first + n - 1, has)]
        distinct, grams = np.unique(pair, return_inverse=True)
        own = np.fromiter((zlib.crc32(b" " + terms[k % len(terms)], int(own[k // len(terms)])) for k in distinct.tolist()), np.int64, len(distinct))
        found.append(own[grams] % buckets)
        owner.append(np.repeat(np.arange(len(sizes)), has))
    return np.concatenate(found), np.concatenate(owner), sizes


def _counts(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.large_string())
            for lo, hi in _slices(texts):
                total += np.bincount(features(texts[lo:hi], longest, buckets)[0], minlength=buckets)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a task sends a row a bucket at most."""
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain long) for every bucket: 1000 ln of the smoothed target share over the smoothed raw share, floored."""
    spark = raw.sparkSession
    joined = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = joined.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return joined.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(up / down)).cast("long").alias("gain"))


def _weights(longest: int, gains: np.ndarray):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for lo, hi in _slices(texts):
                found, owner, words = features(texts[lo:hi], longest, len(gains))
                n = np.bincount(owner, minlength=hi - lo)
                order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
                upto = np.append(0, np.cumsum(gains[found[order]]))
                ends = np.cumsum(n)
                weight = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *(pa.array(c.astype(np.int64)) for c in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: str, doc_id: str):
    """Column: floored 1000-fold Gumbel noise of a document, from the first 32 bits of a SHA-256; no doc_id: of ``seed:``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10000, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (of the drawn ones, else null).

    A feature is a run of 1 to ``longest`` words; weight is the floored mean of the gains of a document's features, 0
    without any; score adds the noise. Of the N documents with ``least_words`` words, floor(percent N / 100) of the
    highest scores are drawn. Null and empty texts: no features, weight 0, never drawn if words are asked for. Ties of
    score: the smaller doc_id, null ids last, then the fewer features; rows that repeat are drawn one by one. A very
    long text is read whole, alone in its slice. An empty target leaves gains from smoothing alone; an empty table
    gives an empty one. Other columns, whatever their names, are not read.
    """
    prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = bucket_gains(bucket_counts(small, longest, buckets), bucket_counts(target, longest, buckets, target_col), buckets)
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in table.collect():  # a row a bucket, a fixed number of them
        gains[bucket] = gain
    weighed = small.mapInArrow(_weights(longest, gains), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(seed, "doc_id")), "scored")
    able = scored.filter(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score", F.lit(1).cast("long").alias("rank"), F.monotonically_increasing_id().alias("turn"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("turn")]
    ranked, totals = running_sums(able, order, ["rank"])
    drawn = percent * (totals["rank"] or 0) // 100
    place = F.col("rank_upto")
    chosen = ranked.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    few = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return chosen.union(few)
