"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of ``width`` consecutive words of every document is hashed, whole corpus, no sampling. Words enter as
64-bit hashes under a seed that each run draws, so no text can be written to collide. Windows meet by hash range; of a
window's occurrences all but those in the smallest doc_id are removable, and the removable windows of a document merge
into maximal removal intervals.

A scan task first settles what it can see itself: an occurrence that has a smaller doc_id in the same block is
removable already and bypasses the exchange, so a passage that a third of all documents share sends one occurrence
from each block, not one from each document. Hashes travel sorted, in byte planes. A block is dealt to FAN ranges at
most; a corpus that needs more has a second exchange, whose tasks cut their range into finer ones, so a block always
sends a few hundred windows a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_seed, keyed, prepare, total_bytes
from .grams import bucket_edges, bucket_of, exchanged, from_planes, grouped, levels, mix64, pieces, run_starts, runs, to_planes, window_hashes, word_hashes, words_of

BLOCK_WINDOWS = 1_000_000
BUCKET_BYTES = 8 << 20
_CELL = "bucket int, direct boolean, docs binary, counts binary, hashes binary, at binary"
_FOUND = "shard int, docs binary, counts binary, at binary"
_SPANS = "doc_id long, starts array<int>, ends array<int>"


def _cell(bucket: int, direct: bool, order_docs: np.ndarray, hashes: np.ndarray, at: np.ndarray, owner: np.ndarray):
    """A cell's rows: for each entry (in hash order) the document's place in the cell's own table and the position."""
    used, place = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    return bucket, direct, to_planes(order_docs[used]), to_planes(place.astype(kind)), to_planes(hashes), to_planes(at.astype(np.uint32))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_CELL_ARROW = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("at", pa.binary())])
_FOUND_ARROW = pa.schema([("shard", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])


def _owners(raw: bytes, entries: int) -> np.ndarray:
    return from_planes(raw, np.uint16 if len(raw) == 2 * entries else np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc ids, hashes, owner rows, positions) of about BLOCK_WINDOWS windows at a time."""
    held, size, base = [], 0, 0
    for batch in batches:
        for piece in pieces(batch, "doc_id", "text"):
            words = words_of(piece)
            hashes, rows, starts = window_hashes(word_hashes(piece, words, seed=seed), words.first, width)
            held.append((piece.ids, hashes, rows + base, starts - words.first[rows]))
            base += len(piece.ids)
            size += len(hashes)
            if size >= BLOCK_WINDOWS:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size, base = [], 0, 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _deal(ids, hashes, owner, at, tie_bits: int, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """A block's cells: what it settles by itself, and the other windows by hash range."""
    order = np.argsort(hashes)
    hashes, owner, at = hashes[order], owner[order], at[order]
    settled = _later(ids[owner], hashes, tie_bits)
    if settled.any():
        none = np.zeros(0, np.uint64)
        yield _table([_cell((turn * 7919) % buckets, True, ids, none, at[settled], owner[settled])], _CELL_ARROW)
    hashes, owner, at = hashes[~settled], owner[~settled], at[~settled]
    full, cuts = bucket_edges(hashes, buckets)
    rows, held = [], 0
    for bucket, lo, hi in zip(full.tolist(), cuts[:-1], cuts[1:], strict=True):
        rows.append(_cell(bucket, False, ids, hashes[lo:hi], at[lo:hi], owner[lo:hi]))
        held += hi - lo
        if held > 250_000:
            yield _table(rows, _CELL_ARROW)
            rows, held = [], 0
    if rows:
        yield _table(rows, _CELL_ARROW)


def _later(docs: np.ndarray, sorted_hashes: np.ndarray, tie_bits: int) -> np.ndarray:
    """Which occurrences have an equal window in a smaller doc_id."""
    if not len(docs):
        return np.zeros(0, bool)
    docs, starts = docs >> tie_bits, run_starts(sorted_hashes)
    return docs > np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))


def _scan(width: int, tie_bits: int, buckets: int, seed: int):
    def run(batches):
        for turn, block in enumerate(_blocks(batches, width, seed)):
            yield from _deal(*block, tie_bits, buckets, turn)

    return run


def _entries(row) -> tuple[np.ndarray, np.ndarray]:
    at = from_planes(row["at"], np.uint32)
    return from_planes(row["docs"], np.int64)[_owners(row["counts"], len(at))], at


def _deal_again(tie_bits: int, buckets: int):
    """Cells of wide ranges to cells of narrow ones, a block of windows at a time."""

    def run(batches):
        held, size, turn = [], 0, 0

        def flush():
            docs, hashes, at = (np.concatenate(c) for c in zip(*held, strict=True))
            ids, owner = np.unique(docs, return_inverse=True)
            return _deal(ids, hashes, owner, at, tie_bits, buckets, turn)

        for batch in batches:
            for row in batch.to_pylist():
                if row["direct"]:
                    turn += 1
                    yield _table([((turn * 7919) % buckets, *list(row.values())[1:])], _CELL_ARROW)
                    continue
                docs, at = _entries(row)
                held.append((docs, from_planes(row["hashes"], np.uint64), at))
                size += len(at)
                if size >= BLOCK_WINDOWS:
                    yield from flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield from flush()

    return run


def _sharded(docs: np.ndarray, at: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    shard = bucket_of(mix64(docs.astype(np.uint64)), shards)
    order = np.lexsort((at, docs, shard))
    docs, at, shard = docs[order], at[order], shard[order]
    rows = []
    for lo, hi in runs(shard):
        first = run_starts(docs[lo:hi])
        rows.append((int(shard[lo]), to_planes(docs[lo:hi][first]), to_planes(np.diff(np.append(first, hi - lo)).astype(np.uint32)), to_planes(at[lo:hi].astype(np.uint32))))
    if rows:
        yield _table(rows, _FOUND_ARROW)


def _found(row) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(from_planes(row["docs"], np.int64), from_planes(row["counts"], np.uint32)), from_planes(row["at"], np.uint32)


def _shard_again(shards: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(_found(row))
                size += len(held[-1][1])
                if size >= BLOCK_WINDOWS:
                    yield from _sharded(*(np.concatenate(c) for c in zip(*held, strict=True)), shards)
                    held, size = [], 0
        if held:
            yield from _sharded(*(np.concatenate(c) for c in zip(*held, strict=True)), shards)

    return run


def _match(tie_bits: int, shards: int):
    def run(batches):
        for _, held in grouped(batches, "bucket"):
            hashes, docs, at = [], [], []
            for part in held:
                for row in part.to_pylist():
                    d, a = _entries(row)
                    if row["direct"]:
                        yield from _sharded(d, a, shards)
                    else:
                        hashes.append(from_planes(row["hashes"], np.uint64))
                        docs.append(d)
                        at.append(a)
            if not hashes:
                continue
            hashes, docs, at = np.concatenate(hashes), np.concatenate(docs), np.concatenate(at)
            order = np.argsort(hashes)
            docs, at = docs[order], at[order]
            gone = _later(docs, hashes[order], tie_bits)
            yield from _sharded(docs[gone], at[gone], shards)

    return run


def _merge(width: int):
    """Removable windows of a document to maximal intervals [start, end) of word positions."""

    def run(batches):
        for _, held in grouped(batches, "shard"):
            docs, at = [], []
            for part in held:
                for row in part.to_pylist():
                    d, a = _found(row)
                    docs.append(d)
                    at.append(a)
            docs, at = np.concatenate(docs), np.concatenate(at).astype(np.int64)
            order = np.lexsort((at, docs))
            docs, at = docs[order], at[order]
            new = np.append(True, (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + width))
            starts = np.flatnonzero(new)
            ends = at[np.append(starts[1:], len(at)) - 1] + width
            owner = docs[starts]
            first = run_starts(owner)
            cuts = pa.array(np.append(first, len(owner)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (at[starts], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), *lists], ["doc_id", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", tie_bits: int = 0) -> DataFrame:
    """(doc_id, starts, ends): maximal intervals of word positions covered by windows that a smaller doc_id has too.

    Only documents with something to remove appear. Rows with a null doc_id or text take no part, nor do texts of fewer
    words than ``width``; very long texts are read whole; an empty table gives an empty one. Rows that repeat a doc_id
    must be told apart by the lowest ``tie_bits`` bits of the column, which say nothing of what is smaller.
    """
    prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    buckets = levels(max(16, -(-total_bytes(small, "text") // BUCKET_BYTES)))
    shards = levels(max(8, buckets[-1] // 4))
    cells = exchanged(small.mapInArrow(_scan(width, tie_bits, buckets[0], fresh_seed()), _CELL), "bucket", buckets[0])
    for more in buckets[1:]:
        cells = exchanged(cells.mapInArrow(_deal_again(tie_bits, more), _CELL), "bucket", more)
    found = exchanged(cells.mapInArrow(_match(tie_bits, shards[0]), _FOUND), "shard", shards[0])
    for more in shards[1:]:
        found = exchanged(found.mapInArrow(_shard_again(more), _FOUND), "shard", more)
    return found.mapInArrow(_merge(width), _SPANS)


def _cut(batches):
    for batch in batches:
        texts, starts, ends = (batch.column(c) for c in ("text", "starts", "ends"))
        counts, gone, kept = [], [], []
        for text, a, b in zip(texts, starts, ends, strict=True):
            words = (text.as_py() or "").encode().split()
            removed = 0
            if a.is_valid:
                left, at = [], 0
                for lo, hi in zip(a.as_py(), b.as_py(), strict=True):
                    left += words[at:lo]
                    removed += min(hi, len(words)) - lo
                    at = hi
                left += words[at:]
            else:
                left = words
            counts.append(len(words))
            gone.append(removed)
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), starts, ends, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "starts", "ends", "kept_text"])


def _rewrite(text_col: str, length_col: str | None, spans: tuple[str, str, str], names: list[str]):
    def run(batches):
        for batch in batches:
            small = pa.RecordBatch.from_arrays([batch.column(c) for c in (spans[0], text_col, spans[1], spans[2])], ["doc_id", "text", "starts", "ends"])
            for done in _cut([small]):
                cut = pc.greater(done.column("n_removed"), 0)
                text = pc.if_else(cut, done.column("kept_text"), batch.column(text_col))
                columns = [text if c == text_col else batch.column(c) for c in names]
                if length_col:
                    at = names.index(length_col)
                    columns[at] = pc.if_else(cut, pc.utf8_length(text).cast(columns[at].type), columns[at])
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out.filter(pc.invert(pc.and_(cut, pc.equal(done.column("kept_text"), ""))))

    return run


def _with_spans(rows: DataFrame, key: str, spans: DataFrame) -> DataFrame:
    """Rows with their removal intervals, null without any; rows without a key stay out of the exchange."""
    owner = spans.columns[0]
    joined = rows.filter(F.col(key).isNotNull()).join(spans, F.col(key) == spans[owner], "left")
    nameless = rows.filter(F.col(key).isNull())
    for field in spans.schema:
        nameless = nameless.withColumn(field.name, F.lit(None).cast(field.dataType))
    return joined.union(nameless)


def cut_documents(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs``, all columns, with repeated passages cut from the text; a document of which nothing is left goes.

    Texts that lose nothing stay as they are, so do null and empty ones and rows with a null doc_id; ``length_col``
    follows a text that is cut. Ties, repeated rows, very long texts and empty tables: as in ``remove_repeats``.
    """
    names = [f"_span_{k}_{len(docs.columns)}" for k in range(4)]
    rows, bits, _ = keyed(docs, id_col, names[3])
    spans = repeated_spans(rows, width, names[3], text_col, bits).toDF(*names[:3])
    return _with_spans(rows, names[3], spans).mapInArrow(_rewrite(text_col, length_col, tuple(names[:3]), docs.columns), docs.schema)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, starts, ends (the removed intervals), kept_text.

    Words are maximal runs of bytes other than space and tab to carriage return; ``kept_text`` joins the kept ones by
    one space. Null or empty text: no words, empty ``kept_text``. A document that has fewer than ``width`` words keeps
    all. Ties: the smallest doc_id keeps a passage; repeats inside one document are no reason to remove, nor are those
    in other rows of the same doc_id, each of which loses its own words. A null doc_id: nothing is removed. Very long
    texts are read whole. An empty table gives an empty one; other columns of ``docs``, whatever their names, are not
    read.
    """
    small, bits, _ = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "key")
    spans = repeated_spans(small, width, "key", "text", bits).withColumnRenamed("doc_id", "owner")
    return _with_spans(small, "key", spans).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept_text string")
