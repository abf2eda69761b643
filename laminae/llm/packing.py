"""Best-fit decreasing packing of token pieces, in one pass.

Pieces are range-sorted, largest first, and each learns its place in the whole order: a range tells how many pieces of
each size it holds, so the sums take a row a range and a row a size. Sizes are whole numbers up to the capacity, and
sequences of equal room are alike; what best fit does to them follows from the number of pieces of each size alone. That
plan is made over sizes and not over pieces: all sequences of the tightest room that a size fits take as many of its
pieces as they hold, before wider ones do. Of each size only one room is left half taken, and a sequence more than
halves its room with each size it takes, so the plan has fewer than 3 x capacity x (2 + log2 capacity) entries,
whatever the number of pieces. Tasks then look up the sequence and offset of each place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import prepare, stored
from .grams import pieces
from .tokens import library_cache, vocabulary_path

TEXT_BYTES = 1 << 20
#: Rows that one task sorts.
SWEEP_ROWS = 100_000


def _cut(vocabulary: str, end_id: int, capacity: int):
    cache = library_cache(vocabulary)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "doc_id", "text", TEXT_BYTES):
                ids, counts = cache.ids_of(piece)
                rows, at = [], 0
                for doc, ok, n in zip(piece.ids.tolist(), piece.valid.tolist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    first = (n % capacity) + 1
                    ends = range(first, n + 2, capacity)
                    for k, end in enumerate(ends):
                        start = 0 if k == 0 else end - capacity
                        rows.append((doc if ok else None, k, start, end - start, zlib.crc32(own[start:end].tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where too long.

    The first piece is the shorter one. Stored, so that ``uid`` stays what it is.
    """
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = small.mapInArrow(_cut_lazily(vocabulary or vocabulary_path(), end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return stored(cut.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


def _cut_lazily(*args):
    return lambda batches: _cut(*args)(batches)


def _ranked(batches):
    """Rows with their range and place in it; after them, how many rows of each length the range holds."""
    part, at, held, schema = TaskContext.get().partitionId(), 0, Counter(), None
    for batch in batches:
        n, schema = batch.num_rows, batch.schema
        sizes, counts = np.unique(np.asarray(batch.column("length")), return_counts=True)
        held.update(dict(zip(sizes.tolist(), counts.tolist(), strict=True)))
        yield _with(batch, part=pa.array(np.full(n, part, np.int32)), place=pa.array(np.arange(at, at + n)), many=pa.nulls(n, pa.int64()))
        at += n
    if held:
        n = len(held)
        told = [pa.array(list(held), pa.int64()) if f.name == "length" else pa.nulls(n, f.type) for f in schema]
        told = pa.RecordBatch.from_arrays(told, schema.names)
        yield _with(told, part=pa.array(np.full(n, part, np.int32)), place=pa.nulls(n, pa.int64()), many=pa.array(list(held.values()), pa.int64()))


def _with(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of ``counts`` pieces by size: (first place, pieces a sequence, first sequence, offset) each.

    Places number the pieces, largest first. The pieces from an entry's first place up to the next entry's go to
    consecutive sequences, so many to each, behind each other from the offset on.
    """
    rooms: list[int] = []  # in ascending order
    alike: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of sequences
    out, place, opened = [], 0, 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in alike:
                insort(rooms, room)
            alike.setdefault(room, []).append((first, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, free = alike[room].pop()
                if not alike[room]:
                    del alike[room], rooms[k]
            else:
                room, first, free = capacity, opened, -(-left // (capacity // size))
                opened += free
            run = room // size
            taken = min(free, -(-left // run))
            n = min(left, taken * run)
            out.append((place, run, first, capacity - room))
            whole, some = divmod(n, run)
            put(room - run * size, first, whole)
            put(room - some * size, first + whole, int(some > 0))
            put(room, first + taken, free - taken)
            place, left = place + n, left - n
    return out


def _placed(plan: list[tuple[int, int, int, int]], before: list[int]):
    def run(batches):
        starts, runs, firsts, offsets = np.array(plan, np.int64).reshape(-1, 4).T
        upto = np.array(before, np.int64)
        for batch in batches:
            part, place, length = (np.asarray(batch.column(c)) for c in ("part", "place", "length"))
            place = upto[part] + place
            entry = np.searchsorted(starts, place, "right") - 1
            turn = place - starts[entry]
            rows = batch.select([c for c in batch.schema.names if c not in ("part", "place", "many")])
            yield _with(rows, bin=pa.array(firsts[entry] + turn // runs[entry]), offset=pa.array(offsets[entry] + turn % runs[entry] * length))

    return run


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (uid long, length long, other columns) with bin and offset, as best-fit decreasing packs them.

    Lengths are from 1 to ``capacity``; bins are numbered from 0.
    """
    prepare(items)
    fields = [StructField(f.name, f.dataType) for f in items.schema]
    kinds = StructType([*fields, StructField("part", IntegerType()), StructField("place", LongType()), StructField("many", LongType())])
    order = [F.desc("length"), F.asc("uid")]
    ranges = max(1, -(-items.count() // SWEEP_ROWS))
    ranked = items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_ranked, kinds).checkpoint()
    counts, parts = Counter(), Counter()
    for r in ranked.filter("many is not null").select("part", "length", "many").collect():  # a row a range and a row a size
        counts[r["length"]] += r["many"]
        parts[r["part"]] += r["many"]
    before = list(accumulate((parts[k] for k in range(max(parts, default=0))), initial=0))
    kinds = StructType([*fields, StructField("bin", LongType()), StructField("offset", LongType())])
    return ranked.filter("many is null").mapInArrow(_placed(fit_plan(counts, capacity), before), kinds)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizers library's for its whole text (null and empty: none) and ``end_id``. Longer ones
    than ``capacity`` are cut into full pieces after a first, maybe shorter, piece. Ties: equal lengths are taken in the
    order of an internal row number; repeated rows and rows with a null doc_id are packed like any other; a very long
    text is cut like any longer one. An empty table gives an empty one; other columns are not read.
    """
    prepare(docs)
    cut = token_pieces(docs, capacity, end_id, vocabulary, id_col, text_col)
    return best_fit(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
