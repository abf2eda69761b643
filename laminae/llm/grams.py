"""Vectorised words, hashes of words and of their windows, and packed columns over Arrow text buffers.

Texts are never turned into Python strings here: a batch's UTF-8 buffer is hashed in place, about a MB at a
time, so memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The bytes that separate words, space and tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.isin(np.arange(256), SPACE_BYTES)
PIECE_BYTES = 1 << 20
#: Bytes of a span up to which numpy hashes it, eight a step; longer ones, which are rare, go to BLAKE2.
LONG_SPAN = 64
#: Groups that one exchange deals to at most: a block then still has a few hundred entries for each.
FAN = 4096
MOST_PARTITIONS = 16384
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_AS_IT_IS = np.arange(256, dtype=np.uint8)
_FOLDED = _AS_IT_IS.copy()
_FOLDED[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` of each at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PIECE_BYTES + 1)
        rows = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            rows.append(np.cumprod(steps, dtype=np.uint64))
        _powers = rows[0], rows[1]
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of values[start:end] for each span, from one prefix sum."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes data[start:end] of each span.

    Eight bytes a step go through a bijective mix, so spans of one length of up to eight bytes never collide; longer
    ones do by chance alone, which nobody can aim at without the seed. Where equality decides, bytes are compared.
    """
    sizes = ends - starts
    own = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", own, strides=(1,))  # the eight bytes from every byte on
    out = mix64(sizes.astype(np.uint64) * np.uint64(_BASE) ^ np.uint64(seed))
    out = mix64(out ^ (wide[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]))
    at, step = np.flatnonzero((sizes > 8) & (sizes <= LONG_SPAN)), 8
    while len(at):
        out[at] = mix64(out[at] * np.uint64(_BASE) ^ (wide[starts[at] + step] & _FIRST_BYTES[np.minimum(sizes[at] - step, 8)]))
        step += 8
        at = at[sizes[at] > step]
    key = seed.to_bytes(8, "little")
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[k] = int.from_bytes(blake2b(own[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, ..., start + size - 1 of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Piece(NamedTuple):
    """Some rows of a batch: ids (int64), their validity, and texts as bytes with n+1 offsets."""

    ids: np.ndarray
    valid: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    first_row: int


def pieces(batch: pa.RecordBatch, id_col: str, text_col: str, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts a batch at rows into pieces of about ``limit`` bytes; null texts count as empty."""
    text = pc.fill_null(batch.column(text_col).cast(pa.large_string()), "")
    ids = batch.column(id_col)
    valid = np.asarray(pc.is_valid(ids))
    numbers = np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))
    _, at, raw = text.buffers()
    offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        lo, hi = offsets[row], offsets[stop]
        yield Piece(numbers[row:stop], valid[row:stop], data[lo:hi], offsets[row : stop + 1] - lo, row)
        row = stop


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, n+1 of them


def words_of(piece: Piece) -> Words:
    """Byte spans of the words ``[^\\x20\\x09-\\x0D]+`` of each document."""
    n = len(piece.data)
    ink = np.zeros(n + 1, bool)
    ink[:n] = ~IS_SPACE[piece.data]
    begins = ink[:n].copy()
    begins[1:] &= ~ink[: n - 1] if n else ink[:0]
    edges = piece.offsets[:-1][piece.offsets[:-1] < n]
    begins[edges] = ink[edges]
    starts = np.flatnonzero(begins)
    closes = ink[:n] & ~ink[1 : n + 1]
    last = piece.offsets[1:][piece.offsets[1:] > 0] - 1
    closes[last] = ink[last]
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, piece.offsets))


def word_hashes(piece: Piece, words: Words, fold_case: bool = False, seed: int = 0) -> np.ndarray:
    return byte_hashes((_FOLDED if fold_case else _AS_IT_IS)[piece.data], words.starts, words.ends, seed)


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int, short_too: bool = False):
    """Hashes of all windows of ``width`` words inside one document: (hash, document row, first word).

    ``short_too``: a document with fewer words, but some, counts as one window.
    """
    counts = np.diff(first)
    windows = np.maximum(counts - width + 1, 0)
    spans = np.full(len(counts), width)
    if short_too:
        short = (counts > 0) & (counts < width)
        windows, spans = np.where(short, 1, windows), np.where(short, counts, spans)
    rows = np.repeat(np.arange(len(counts)), windows)
    starts = np.arange(len(rows)) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)
    return span_hashes(hashes, starts, starts + spans[rows]), rows, starts


def to_planes(values: np.ndarray) -> bytes:
    """Byte planes of an array: the shuffle's codec then shrinks the slow-moving high bytes of sorted values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, by the upper half; ranges of a multiple of ``buckets`` lie inside these."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty ranges only: (bucket numbers, n+1 cut points)."""
    own = bucket_of(sorted_hashes, buckets)
    starts = run_starts(own)
    return own[starts], np.append(starts, len(own))


def levels(groups: int) -> list[int]:
    """Numbers of groups to deal to, one exchange each: at most FAN times more groups from one to the next."""
    if groups <= FAN:
        return [groups]
    fine = -(-groups // FAN)
    return [FAN, FAN * min(fine, FAN)]


def exchanged(cells: DataFrame, key: str, groups: int) -> DataFrame:
    """Cells of one key in one task, keys sorted; Spark sorts and spills, so a task may hold many keys."""
    return cells.repartition(min(groups, MOST_PARTITIONS), key).sortWithinPartitions(key)


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first element of every run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of every run of equal values."""
    starts = run_starts(sorted_values).tolist()
    return zip(starts, starts[1:] + [len(sorted_values)] * bool(starts), strict=True)


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a partition sorted by ``key``, one key at a time (zero-copy slices)."""
    current, held = None, []
    for batch in batches:
        keys = np.asarray(batch.column(key))
        for lo, hi in runs(keys):
            if held and keys[lo] != current:
                yield current, held
                held = []
            current = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, held
