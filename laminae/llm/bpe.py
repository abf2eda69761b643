"""Byte-level BPE over a global table of distinct words.

Documents are dealt into blocks. A block's distinct pre-token words, exploded in the order of their hashes, meet those
of all other blocks by hash range; a task encodes every distinct word of its range once, whatever number of blocks it
comes from, and the ids join back to the blocks that hold the word. A block reassembles its documents by position.
Both uses of the blocks share one exchange. Either side can compute the hashes, so neither hashes nor positions travel.
Decoding joins ids to the table of token bytes, which the vocabulary bounds.

Hashes only route: a block compares every word with the first of its hash, and words that differ from it travel as
further words of their own; encoding compares bytes as well. A word is a run of pattern matches that ends where white
space begins, so matches are still encoded one by one.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, total_bytes
from .grams import MOST_PARTITIONS, Piece, bucket_edges, byte_hashes, from_planes, pieces, ragged, to_planes
from .tokens import ChunkCache, chunk_spans, vocabulary_path

MULTI_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
#: Ranges of hashes at most: a block has about a hundred words for each, and a task reads them as a stream.
MOST_BUCKETS = 1024
OUT_BYTES = 1 << 20
_BLOCKS = "block long, docs binary, offsets binary, text binary"
_WORDS = "bucket int, block long, turn int, sizes binary, bytes binary"
_IDS = "block long, turn int, sizes binary, ids binary"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _pack(batches):
    """Rows to blocks of about BLOCK_BYTES of text, compressed."""
    part, turn = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=3)
    held, size = [], 0

    def block():
        ids = np.concatenate([p.ids for p in held])
        valid = np.concatenate([p.valid for p in held])
        sizes = np.concatenate([np.diff(p.offsets) for p in held]).astype(np.uint32)
        text = squeeze.compress(b"".join(p.data.tobytes() for p in held))
        row = [(part << 24) | turn, to_planes(ids) + valid.tobytes(), to_planes(sizes), text]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "docs", "offsets", "text"])

    for batch in batches:
        for piece in pieces(batch, "doc_id", "text"):
            held.append(piece._replace(data=piece.data.copy()))
            size += len(piece.data)
            if size >= BLOCK_BYTES:
                yield block()
                held, size, turn = [], 0, turn + 1
    if held:
        yield block()


def _unpack(row) -> Piece:
    sizes = from_planes(row["offsets"], np.uint32)
    n = len(sizes)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    return Piece(from_planes(row["docs"][: 8 * n], np.int64), np.frombuffer(row["docs"][8 * n :], bool), data, np.append(0, np.cumsum(sizes)).astype(np.int64), 0)


def _slices(piece: Piece):
    """About a MB of whole documents at a time: (Piece, starts, ends, first, hashes of words)."""
    row = 0
    while row < len(piece.ids):
        stop = max(row + 1, int(np.searchsorted(piece.offsets, piece.offsets[row] + OUT_BYTES, "right")) - 1)
        lo, hi = piece.offsets[row], piece.offsets[stop]
        part = Piece(piece.ids[row:stop], piece.valid[row:stop], piece.data[lo:hi], piece.offsets[row : stop + 1] - lo, row)
        starts, ends, first = chunk_spans(part)
        yield part, starts, ends, first, byte_hashes(part.data, starts, ends)
        row = stop


class _Words:
    """A block's distinct words: the first one of each hash, in the order of hashes, then those that differ from it."""

    def __init__(self, piece: Piece):
        self.piece, self.slices = piece, list(_slices(piece))
        keys, at, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, starts, ends, _, hashes in self.slices:
            own, place = np.unique(hashes, return_index=True)
            keys.append(own)
            at.append(starts[place] + piece.offsets[part.first_row])
            sizes.append((ends - starts)[place])
        self.keys, place = np.unique(np.concatenate(keys), return_index=True)
        self.at, self.sizes = np.concatenate(at)[place], np.concatenate(sizes)[place]
        self.others: dict[bytes, int] = {}

    def slots(self):
        """(Piece, first word of each document, place of every word among the distinct ones) of each slice."""
        for part, starts, ends, first, hashes in self.slices:
            slot = np.searchsorted(self.keys, hashes)
            lengths = ends - starts
            other = self.sizes[slot] != lengths
            same = np.flatnonzero(~other)
            unlike = self.piece.data[ragged(self.at[slot[same]], lengths[same])] != part.data[ragged(starts[same], lengths[same])]
            if unlike.any():
                other[same[np.searchsorted(np.cumsum(lengths[same]), np.flatnonzero(unlike), "right")]] = True
            for k in np.flatnonzero(other).tolist():
                word = part.data[starts[k] : ends[k]].tobytes()
                slot[k] = len(self.keys) + self.others.setdefault(word, len(self.others))
            yield part, first, slot


def _distinct(buckets: int):
    """Each block's distinct words, dealt by hash range; ``turn`` is the order in which the block wants them back."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _Words(_unpack(row))
                for _ in words.slots():
                    pass
                full, cuts = bucket_edges(words.keys, buckets)
                rows = [(b, row["block"], b, to_planes(words.sizes[lo:hi].astype(np.uint32)), words.piece.data[ragged(words.at[lo:hi], words.sizes[lo:hi])].tobytes()) for b, lo, hi in zip(full.tolist(), cuts[:-1], cuts[1:], strict=True)]
                if words.others:
                    sizes = np.array([len(w) for w in words.others], np.uint32)
                    rows.append((row["block"] % buckets, row["block"], buckets, to_planes(sizes), b"".join(words.others)))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "turn", "sizes", "bytes"])

    return run


def _encode(path: str):
    """Encodes each distinct word of a bucket once and sends its ids to every block that holds it."""

    def run(batches):
        import public_tokenizers
        import tiktoken

        ranks = ranks_of(path)
        encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        table = ChunkCache(lambda texts: [encoder.encode_ordinary(t) for t in texts], _kind(ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                sizes = [from_planes(r["sizes"], np.uint32).astype(np.int64) for r in rows]
                ends = np.cumsum(np.concatenate(sizes))
                ids, counts = table.ids_of_spans(np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8), ends - np.concatenate(sizes), ends)
                of_word, of_id = np.cumsum([0] + [len(s) for s in sizes]), np.append(0, np.cumsum(counts))
                raw = [(to_planes(counts[lo:hi].astype(np.uint32)), to_planes(ids[of_id[lo] : of_id[hi]])) for lo, hi in zip(of_word[:-1], of_word[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["turn"] for r in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*raw, strict=True))], ["block", "turn", "sizes", "ids"])

    return run


def _kind(ranks: dict[bytes, int]):
    return np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32


def _reassemble(kind):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        """Ids of a block's documents, by position."""
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for row in sorted(words.to_pylist(), key=lambda r: r["turn"]):
            counts.append(from_planes(row["sizes"], np.uint32).astype(np.int64))
            flat.append(from_planes(row["ids"], kind))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        starts = np.cumsum(counts) - counts
        out = []
        for row in blocks.to_pylist():
            own = _Words(_unpack(row))
            for part, first, slot in own.slots():
                ids = flat[ragged(starts[slot], counts[slot])]
                bounds = np.append(0, np.cumsum(counts[slot]))[first]
                raw = pa.Array.from_buffers(pa.large_binary(), len(part.ids), [None, pa.py_buffer(ids.itemsize * bounds), pa.py_buffer(ids)]).cast(pa.binary())
                out.append(pa.Table.from_arrays([pa.array(part.ids, mask=~part.valid), pa.array(np.diff(bounds)), raw], ["doc_id", "n_tokens", "ids"]))
            if len(own.keys) + len(own.others) != len(counts):
                raise ValueError("a block's words and their ids do not belong together")
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned numbers of 16 bits, or of 32 if ranks need it).

    Null and empty texts have no ids; a very long text is a block of its own. Repeated rows and rows with a null doc_id
    are encoded like any other; an empty table gives an empty one; other columns are not read.
    """
    prepare(docs)
    path = vocabulary or vocabulary_path(MULTI_VOCABULARY)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(8, -(-total_bytes(small, "text") // BUCKET_BYTES))
    buckets = min(parts, MOST_BUCKETS)
    blocks = small.mapInArrow(_pack, _BLOCKS).repartition(min(parts, MOST_PARTITIONS), "block")
    words = blocks.mapInArrow(_distinct(buckets), _WORDS).repartition(buckets, "bucket")
    ids = words.mapInArrow(_encode(path), _IDS)
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_reassemble(_kind(ranks_of(path))), "doc_id long, n_tokens long, ids binary")


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The table of token bytes: (all bytes by id, start of each id's, with the end)."""
    ranks = ranks_of(path)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))


def _decode(path: str):
    def run(batches):
        table, starts = token_bytes(path)
        sizes, kind = np.diff(starts), "<u2" if len(starts) <= (1 << 16) + 1 else "<u4"
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("ids")), 0), dtype=np.int64))
            row = 0
            while row < batch.num_rows:  # about a MB of ids at a time
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + OUT_BYTES, "right")))
                part = batch.slice(row, stop - row)
                row = stop
                raw = part.column("ids").to_pylist()
                ids = [np.frombuffer(x or b"", kind).astype("<u4") for x in raw]
                text = table[ragged(starts[np.concatenate(ids)], sizes[np.concatenate(ids)])].tobytes()
                cuts = np.append(0, np.cumsum([int(sizes[x].sum()) for x in ids])).tolist()
                decoded = [None if x is None else text[a:b] for x, a, b in zip(raw, cuts[:-1], cuts[1:], strict=True)]
                wide = [None if x is None else own.tobytes() for x, own in zip(raw, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), pa.array(wide, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary) to (doc_id, n_tokens, ids) and widens ``ids`` to 32-bit numbers.

    Null ids decode to null, none to no bytes; repeated rows and null doc_ids pass through, an empty table gives an
    empty one. Rows are decoded about a MB of ids at a time, a longer one by itself.
    """
    return encoded.mapInArrow(_decode(vocabulary or vocabulary_path(MULTI_VOCABULARY)), "doc_id long, n_tokens long, ids binary, decoded binary")
