"""Exact dedup: counting quotient filters per partition, merged losslessly, then byte verification.

A 64-bit fingerprint splits into block and quotient (its high bits) and remainder. Each scan task keeps one filter for
each block; filters of a block merge by their sorted remainders, counters added, into exactly the filter of all rows.
Only fingerprints counted more than once route their texts to verification, where whole texts are compared as bytes.

Copies collapse before every exchange: a filter has one counter for a fingerprint, and a task sends a text to
verification once for each batch that holds it, so a text that a third of all rows share moves a few times. Other texts
do not move: tasks drop them by the repeated fingerprints, which they hold as long as those are few enough to send, or
by a set of bits of fixed size beyond that, behind which a join drops what the bits let pass.

Rows learn their group from its checksum. Groups of a thousandth of all rows, a thousand at most, are broadcast; the
rows of all others join by checksum, so that no task gets more than a thousandth of the rows for one key.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored
from .grams import grouped

ROWS_PER_BLOCK = 100_000
ROWS_PER_FILTER = 1_000_000
QUOTIENT_BITS = 16
#: Repeated fingerprints that are sent to all tasks as they are, 8 bytes each, and bits of the set that stands in for more.
SENT_FINGERPRINTS = 2_000_000
SET_BITS = 1 << 27
SET_PIECES = 64
#: A group with at least one in so many rows is broadcast, so at most so many are.
HOT_SHARE = 1000


class CountingQuotientFilter:
    """A multiset of fingerprints below 2**bits: occupied quotients, run ends, sorted remainders, counters.

    Stored without empty slots. ``occupied`` has a bit for each quotient, ``run_ends`` a bit for each remainder that
    is the last of its quotient's run, ``counted`` a bit for each remainder that a counter above one follows.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, bits: int):
        self.values, self.counts, self.bits = values, counts, bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints, return_counts=True)
        return cls(values, counts.astype(np.int64), bits)

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        filters = list(filters)
        values = np.concatenate([f.values for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        return cls(values[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)

    def to_bytes(self) -> bytes:
        q = min(QUOTIENT_BITS, self.bits)
        low = np.uint64(self.bits - q)
        quotients = (self.values >> low).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True)[: len(quotients)]
        counted = self.counts > 1
        remainders = self.values & np.uint64((1 << int(low)) - 1)
        parts = [np.packbits(occupied), np.packbits(run_ends), np.packbits(counted), remainders, self.counts[counted]]
        return np.array([self.bits, len(self.values)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, n = np.frombuffer(raw, np.int64, 2).tolist()
        q = min(QUOTIENT_BITS, bits)
        at = 16

        def take(kind, count):
            nonlocal at
            part = np.frombuffer(raw, kind, count, at)
            at += part.nbytes
            return part

        occupied = np.unpackbits(take(np.uint8, ((1 << q) + 7) // 8), count=1 << q)
        run_ends = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n)
        counted = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)
        remainders = take(np.uint64, n)
        counts = np.ones(n, np.int64)
        counts[counted] = take(np.int64, int(counted.sum()))
        runs = np.concatenate([[0], np.cumsum(run_ends[:-1])]).astype(np.int64)[:n]
        quotients = np.flatnonzero(occupied).astype(np.uint64)[runs]
        return cls((quotients << np.uint64(bits - q)) | remainders, counts, bits)

    def count(self, fingerprints: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, fingerprints)
        at = np.minimum(at, max(len(self.values) - 1, 0))
        return np.where(self.values[at] == fingerprints, self.counts[at], 0) if len(self.values) else np.zeros(len(fingerprints), np.int64)


_FILTERS = pa.schema([("block", pa.int32()), ("filter", pa.binary())])


def _filters(block_bits: int):
    bits = 64 - block_bits

    def flush(held):
        fingerprints = np.sort(np.concatenate(held))
        blocks = (fingerprints >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(fingerprints), np.int64)
        cuts = np.searchsorted(blocks, np.arange((1 << block_bits) + 1))
        low = np.uint64((1 << bits) - 1)
        rows = [(b, CountingQuotientFilter.build(fingerprints[lo:hi] & low, bits).to_bytes()) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_FILTERS)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column("fp")).view(np.uint64))
            n += batch.num_rows
            if n >= ROWS_PER_FILTER:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _repeated(block_bits: int):
    def run(batches):
        for block, held in grouped(batches, "block"):
            merged = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(x.as_py()) for part in held for x in part.column("filter"))
            many = merged.counts > 1
            full = merged.values[many] | (np.array([block], np.uint64) << np.uint64(64 - block_bits) if block_bits else np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(merged.counts[many])], ["fp", "copies"])

    return run


def rows_of(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """(fp, copies) of the fingerprints in column ``fp`` (long) that occur more than once."""
    prepare(rows)
    blocks = max(8, rows_of(rows) // ROWS_PER_BLOCK)
    block_bits = min(20, (blocks - 1).bit_length())
    parts = max(1, min(blocks, 4096))
    filters = rows.select("fp").mapInArrow(_filters(block_bits), "block int, filter binary").repartition(parts, "block").sortWithinPartitions("block")
    return filters.mapInArrow(_repeated(block_bits), "fp long, copies long")


def _bits(batches):
    """One set for all fingerprints of a task, a fingerprint a bit, cut into pieces."""
    held = np.zeros(SET_BITS >> 3, np.uint8)
    for batch in batches:
        at = np.asarray(batch.column("fp")).view(np.uint64) >> np.uint64(64 - (SET_BITS - 1).bit_length())
        np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    step = len(held) // SET_PIECES
    for k in range(SET_PIECES):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([held[k * step : (k + 1) * step].tobytes()], pa.binary())], ["piece", "bits"])


def _either(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            own = np.frombuffer(raw, np.uint8)
            total[piece] = total[piece] | own if piece in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "bits"])


def _holder(repeated: DataFrame, n: int):
    """(what tasks drop other texts by, whether it lets only repeated fingerprints pass); its size is bounded."""
    if n <= SENT_FINGERPRINTS:
        return np.sort(np.array([r["fp"] for r in repeated.select("fp").collect()], np.int64)), True
    few = repeated.select("fp").coalesce(16).mapInArrow(_bits, "piece int, bits binary")
    rows = few.repartition(SET_PIECES, "piece").mapInArrow(_either, "piece int, bits binary").collect()
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(rows, key=lambda r: r["piece"])), np.uint8), False


def _held(fingerprints: np.ndarray, holder: np.ndarray) -> np.ndarray:
    if holder.dtype == np.uint8:
        at = fingerprints.view(np.uint64) >> np.uint64(64 - (SET_BITS - 1).bit_length())
        return (holder[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    if not len(holder):
        return np.zeros(len(fingerprints), bool)
    return holder[np.minimum(np.searchsorted(holder, fingerprints), len(holder) - 1)] == fingerprints


def _combine(handle):
    """Texts of a batch that may be repeated; equal ones, compared as bytes, to one row with number and largest id."""

    def run(batches):
        for batch in batches:
            own = batch.filter(pa.array(_held(np.asarray(batch.column("fp")), handle.value)))
            seen: dict[bytes, list] = {}
            ids, fps = own.column("doc_id").to_pylist(), own.column("fp").to_pylist()
            for doc, fp, text in zip(ids, fps, own.column("text").cast(pa.binary()).to_pylist(), strict=True):
                row = seen.setdefault(text, [fp, doc, 0])
                row[2] += 1
                if doc is not None and (row[1] is None or doc > row[1]):
                    row[1] = doc
            if seen:
                fp, top, n = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(list(seen), pa.binary()), pa.array(top, pa.int64()), pa.array(n, pa.int64())], ["fp", "bytes", "top", "n"])

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and empty texts equal each other. Of equal texts the
    largest doc_id stays. Repeated rows, with one doc_id and text, count each in ``group_size``, and one of them stays.
    A null doc_id stays only where the whole group has none. Very long texts are compared whole. An empty table gives
    an empty one; other columns, whatever their names, are not read.
    """
    spark = prepare(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    repeated = stored(repeated_fingerprints(base), "repeated")
    holder, exact = _holder(repeated, repeated.count())
    texts = base.mapInArrow(_combine(spark.sparkContext.broadcast(holder)), "fp long, bytes binary, top long, n long")
    if not exact:
        texts = texts.join(repeated, "fp", "left_semi")
    groups = texts.groupBy("fp", "bytes").agg(F.max("top").alias("top"), F.sum("n").alias("n")).filter("n > 1")
    groups = stored(groups.select(F.sha2("bytes", 256).alias("sha"), "top", "n"), "groups")
    least = max(2, -(-rows_of(docs) // HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col("n") >= least).select(F.col("sha").alias("hot_sha"), F.col("top").alias("hot_top"), F.col("n").alias("hot_n")))
    rows = base.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).join(hot, F.col("text_sha256") == hot["hot_sha"], "left")
    # rows of hot groups meet nothing more: their key has their id in it, which deals them out and keeps repeated rows together
    key = F.when(F.col("hot_n").isNull(), F.col("text_sha256")).otherwise(F.concat_ws(" ", "text_sha256", "doc_id"))
    joined = rows.withColumn("key", key).join(groups.filter(F.col("n") < least), F.col("key") == F.col("sha"), "left")
    size, top = F.coalesce("hot_n", "n", F.lit(1)), F.when(F.col("hot_n").isNotNull(), F.col("hot_top")).when(F.col("n").isNotNull(), F.col("top")).otherwise(F.col("doc_id"))
    out = joined.select("key", "doc_id", "text_sha256", top.alias("keep_id"), size.alias("group_size"))
    turn = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("keep_id"))
    return out.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "text_sha256")
