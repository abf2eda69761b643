"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank of frequency over the whole corpus, so that common ids take one byte. A control byte
holds the lengths, one to four bytes, of four ranks; control bytes and data bytes are kept apart, and a reader turns
control bytes into lengths, and ranks into ids, by numpy table lookup.

A file set is a folder of ``blocks`` (Parquet, uncompressed: part, block, first_id, doc_ids, counts, control, data) in
ascending doc_id order and of ``ranks`` (the id of each rank).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, scratch_path, stored
from .grams import pieces
from .tokens import library_cache, vocabulary_path

TEXT_BYTES = 1 << 20
BLOCK_IDS = 1 << 18
#: Compressed ids of a range of documents that one task writes.
PART_BYTES = 8 << 20
#: Parts of a group: a task of a running sum sees a group or one row a group.
GROUP = 1000
#: Lengths of the four numbers that each control byte describes, two bits each, lowest first.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("valid", pa.binary()), ("counts", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of numbers below 2**32; the last control byte is padded with one-byte zeros."""
    n = -(-len(numbers) // 4) * 4
    full = np.zeros(n, "<u4")
    full[: len(numbers)] = numbers
    sizes = 1 + (full > 0xFF).astype(np.uint8) + (full > 0xFFFF) + (full > 0xFFFFFF)
    control = ((sizes - 1).reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(1).astype(np.uint8)
    used = np.arange(4) < sizes[:, None]
    return control.tobytes(), full.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    out = np.zeros((len(sizes), 4), np.uint8)
    out[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)[:n]


def _tokenise(path: str, end_id: int):
    def run(batches):
        cache, squeeze = library_cache(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in pieces(batch, "doc_id", "text", TEXT_BYTES):
                ids, counts = cache.ids_of(piece)
                wide = ids.itemsize > 2 or end_id > 0xFFFF
                ids = ids.astype("<u4" if wide else "<u2")
                cuts = np.append(0, np.cumsum(counts))
                raw = [squeeze.compress(np.append(ids[a:b], ids.dtype.type(end_id)).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(piece.ids, mask=~piece.valid), pa.array([wide] * len(raw)), pa.array(raw, pa.binary())], ["doc_id", "wide", "ids"])

    return run


def _ids(batch: pa.RecordBatch, opener: zstandard.ZstdDecompressor):
    for wide, raw in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(opener.decompress(raw.as_buffer()), "<u4" if wide else "<u2")


def _frequencies(batches):
    total, opener = np.zeros(1 << 16, np.int64), zstandard.ZstdDecompressor()
    held: list[np.ndarray] = []

    def add():
        nonlocal total
        if held:
            own = np.bincount(np.concatenate(held))
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
            held.clear()

    for batch in batches:
        for ids in _ids(batch, opener):
            held.append(ids)
        add()
    seen = np.flatnonzero(total)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _write(rank_of: np.ndarray):
    def block(part, number, first, docs, valid, counts, ids):
        ranks = rank_of[np.concatenate(ids)]
        control, data = encode_numbers(ranks)
        columns = [part, number, first, len(ranks), np.array(docs, np.int64).tobytes(), np.array(valid, np.uint8).tobytes(), np.array(counts, np.uint32).tobytes(), control, data]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

    def run(batches):
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0
        opener = zstandard.ZstdDecompressor()
        docs, valid, counts, ids = [], [], [], []
        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), _ids(batch, opener), strict=True):
                docs.append(doc or 0)
                valid.append(doc is not None)
                counts.append(len(own))
                ids.append(own)
                size += len(own)
                if size >= BLOCK_IDS:
                    yield block(part, number, first, docs, valid, counts, ids)
                    number, first, size = number + 1, first + size, 0
                    docs, valid, counts, ids = [], [], [], []
        if docs:
            yield block(part, number, first, docs, valid, counts, ids)

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all documents and writes a file set at ``path``, in ascending doc_id order (null ids first).

    Null and empty texts hold the end id alone; equal ids keep any order among them; other columns are not read.
    """
    spark = prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = stored(small.mapInArrow(_tokenise(vocabulary or vocabulary_path(), end_id), "doc_id long, wide boolean, ids binary"), "ids")
    counted = ids.mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in counted.orderBy(F.desc("n"), "id").select("id").collect()]  # one row an id of the vocabulary
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    held = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(4, -(-held // PART_BYTES))
    dealt = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    schema = "part int, block int, first_id long, n_ids long, doc_ids binary, valid binary, counts binary, control binary, data binary"
    dealt.mapInArrow(_write(rank_of), schema).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, counts = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
                ids = id_of[decode_numbers(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(counts)
                raw = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                nulls = ~np.frombuffer(row["valid"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=nulls), pa.array(row["base"] + row["first_id"] + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def part_bases(blocks: DataFrame) -> DataFrame:
    """(part, base): ids of all parts before; sums of groups of parts first, then inside each group."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n").alias("all")).select("group", F.coalesce(F.sum("all").over(before.orderBy("group")), F.lit(0)).alias("ahead"))
    inside = sizes.select("part", "group", F.coalesce(F.sum("n").over(before.partitionBy("group").orderBy("part")), F.lit(0)).alias("inside"))
    return inside.join(groups, "group").select("part", (F.col("ahead") + F.col("inside")).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from a file set; ``ids`` are little-endian unsigned 32-bit numbers.

    A null doc_id comes back null, a document of the end id alone has one token, a file set of no document gives an
    empty table, a document of any length is one row. Documents of one doc_id follow each other in any order.
    """
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(max(1, len(ranks)), "<u4")
    for row in ranks:
        id_of[row["rank"]] = row["id"]
    blocks = spark.read.parquet(f"{path}/blocks")
    based = blocks.join(part_bases(blocks), "part")
    return based.mapInArrow(_read(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Writes a file set in the shared folder and reads it back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, end_id, vocabulary)
    return read_token_files(docs.sparkSession, path)
