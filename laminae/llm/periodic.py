"""Periodic runs: maximal stretches of words that repeat with a period, three times over at least.

Scale-tiled. A document's words become numbers (equal bytes, equal number), and for every octave of periods the
document is exploded into overlapping tiles whose length goes with the period; a tile without a repeated window that
fits the octave is left out at once, by rolling hashes. Tiles are dealt to all tasks, whatever document they are of, and
solved by themselves: at boundaries a few words apart, Z-functions to the right and to the left tell for every period
of the octave how far the words around the boundary repeat. The fragments are shuffled by document and period, and
Spark stitches those that overlap into maximal intervals. Work is n log n words for n words, also where all are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_seed, prepare, stored
from .grams import Piece, Words, byte_hashes, mix64, pieces, ragged, run_starts, span_hashes, words_of

#: Fixed values of the task: the fewest words of a run, and its fewest repeats.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Periods below this are one octave: their runs are no shorter than LEAST_WORDS anyhow.
FIRST = 8
#: Boundaries of a tile; a tile of an octave from p on has so many times p words, and a margin.
TILE_STEPS = 64
#: Words that the Z-functions of a task work on at a time.
LANE_WORDS = 4_000_000
#: Bytes of tiles that a task solves, about: they are few for the work they are.
TASK_BYTES = 1 << 20
#: Lanes below which a loop of its own for each is faster than steps for all.
FEW_LANES = 64
_DOC = "kind int, row long, doc_id long, n_words long, plain string, words string, base long, low long, ids binary"
_DOC_ARROW = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("plain", pa.string()), ("words", pa.string()), ("base", pa.int64()), ("low", pa.int64()), ("ids", pa.binary())])


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(least period, end of periods, step between boundaries) of every octave that a text of n words can have.

    A run of period p that is long enough repeats over 2 p places at least, and over 2 FIRST at the first octave, so
    that two boundaries or more lie on them, the first of which has a whole step of repeats to its right.
    """
    yield 1, 2 * FIRST, FIRST
    low = 2 * FIRST
    while LEAST_TIMES * low <= n:
        yield low, 2 * low, low
        low *= 2


def word_numbers(piece: Piece, words: Words, seed: int) -> np.ndarray:
    """A number for every word of the piece: the same for the same bytes, which are compared, and for no others."""
    hashes = byte_hashes(piece.data, words.starts, words.ends, seed)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = words.ends - words.starts
    model = first[back]
    other = sizes[model] != sizes
    same = np.flatnonzero(~other)
    unlike = piece.data[ragged(words.starts[model[same]], sizes[same])] != piece.data[ragged(words.starts[same], sizes[same])]
    if unlike.any():
        other[same[np.searchsorted(np.cumsum(sizes[same]), np.flatnonzero(unlike), "right")]] = True
    if other.any():  # equal hashes of unlike words: by their bytes
        known: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(other).tolist():
            back[k] = known.setdefault((int(back[k]), piece.data[words.starts[k] : words.ends[k]].tobytes()), len(first) + len(known))
    return back.astype(np.uint32)


def _hits(mixed: np.ndarray, first: np.ndarray, low: int, high: int, step: int) -> np.ndarray:
    """Boundaries (places in ``mixed``) with a period of the octave that goes on for a step, by rolling hashes.

    Equal windows have equal hashes, so none is missed; one that only looks equal costs a look at its boundary.
    """
    n, sizes = len(mixed), np.diff(first)
    count = np.where(sizes >= low + step, (sizes - low - step) // step + 1, 0)
    if not count.any():
        return np.zeros(0, np.int64)
    places = np.repeat(first[:-1], count) + step * ragged(np.zeros(len(count), np.int64), count)
    ends = np.repeat(first[1:], count)
    starts = np.arange(n - step + 1)
    windows = span_hashes(mixed, starts, starts + step)
    out = []
    a_time = max(1, 2_000_000 // (high - low))
    for k in range(0, len(places), a_time):
        at, end = places[k : k + a_time], ends[k : k + a_time]
        there = at[:, None] + np.arange(low, high)
        same = (windows[np.minimum(there, len(windows) - 1)] == windows[at][:, None]) & (there + step <= end[:, None])
        out.append(at[same.any(1)])
    return np.concatenate(out)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return mix64(numbers.astype(np.uint64) + np.uint64(1))


def _tiles(numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(document, first word of the tile in it, octave, numbers of the tile and its margins) of tiles with a hit.

    A tile holds a step before its own words, for the Z-functions to the left, and a step and the longest period after.
    """
    mixed = _mixed(numbers)
    longest = int(np.diff(first).max()) if len(first) > 1 else 0
    for low, high, step in octaves(longest):
        hits = _hits(mixed, first, low, high, step)
        doc = np.searchsorted(first, hits, "right") - 1
        tile = (hits - first[doc]) // (step * TILE_STEPS)
        for k in run_starts(doc * (1 << 40) + tile).tolist():
            d, start = int(doc[k]), int(tile[k]) * step * TILE_STEPS
            lo, hi = max(0, start - step), start + step * TILE_STEPS + step + high
            yield d, lo, low, numbers[first[d] + lo : min(first[d] + hi, first[d + 1])]


def _packed(ids: np.ndarray) -> bytes:
    """A tile's words, numbered anew, behind four bytes that tell their width."""
    values, own = np.unique(ids, return_inverse=True)
    wide = len(values) > 1 << 16
    return bytes([wide, 0, 0, 0]) + own.astype(np.uint32 if wide else np.uint16).tobytes()


def _scan(seed: int):
    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "doc_id", "text"):
                words = words_of(piece)
                numbers = word_numbers(piece, words, seed)
                rows, tiled = [], set()
                for d, lo, low, ids in _tiles(numbers, words.first):
                    tiled.add(d)
                    rows.append((1, (part << 40) + row + d, None, None, None, None, lo, low, _packed(ids)))
                raw = piece.data.tobytes()
                for d in range(len(piece.ids)):
                    text = raw[piece.offsets[d] : piece.offsets[d + 1]]
                    joined = b" ".join(text.split())
                    rows.append((0, (part << 40) + row + d, int(piece.ids[d]) if piece.valid[d] else None, int(words.first[d + 1] - words.first[d]), sha256(joined).hexdigest(), joined.decode() if d in tiled else None, None, None, None))
                row += len(piece.ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DOC_ARROW.types, strict=True)], schema=_DOC_ARROW)

    return run


def _z_function(values: list) -> list:
    n = len(values)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for at in range(1, n):
        size = min(z[at - left], right - at) if at < right else 0
        if at + size >= right:
            while at + size < n and values[size] == values[at + size]:
                size += 1
            left, right = at, at + size
        z[at] = size
    return z


def z_functions(lanes: np.ndarray) -> np.ndarray:
    """Z-functions of the rows of a matrix: z[i, p] words from p on equal the first ones.

    Many rows go side by side: the rightmost match is kept for each row, and a row takes a step of matching or steps to
    the next place at a time, so two passes over a row's length end it, whatever is in it.
    """
    rows, n = lanes.shape
    if rows < FEW_LANES:
        return np.array([_z_function(row) for row in lanes.tolist()], np.int32).reshape(rows, n)
    z = np.zeros((rows, n), np.int32)
    z[:, 0] = n
    at = np.ones(rows, np.int64)
    left, right = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    size = np.zeros(rows, np.int64)  # words known to match from ``at`` on
    live = np.arange(rows) if n > 1 else np.zeros(0, np.int64)
    while len(live):
        a, s = at[live], size[live]
        more = a + s < n
        more[more] = lanes[live[more], s[more]] == lanes[live[more], (a + s)[more]]
        size[live[more]] += 1
        todo = live[~more]
        a, s = at[todo], size[todo]
        z[todo, a] = s
        wide = a + s > right[todo]
        left[todo[wide]], right[todo[wide]] = a[wide], (a + s)[wide]
        at[todo] += 1
        while len(todo):  # places whose match ends inside the known one are copied until one is not
            todo = todo[at[todo] < n]
            a, r = at[todo], right[todo]
            inside = np.maximum(r - a, 0)
            copy = np.where(a < r, z[todo, a - left[todo]], 0)
            whole = copy < inside
            size[todo[~whole]] = inside[~whole]
            todo = todo[whole]
            z[todo, at[todo]] = copy[whole]
            at[todo] += 1
        live = live[at[live] < n]
    return z


def _lanes(tile: np.ndarray, bounds: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that the Z-functions read: (to the right of each boundary, to its left); places outside equal nothing.

    To the left stand the step before the boundary, backwards, a mark, and the words before boundary + period, backwards.
    """
    n = len(tile)
    ahead = bounds[:, None] + np.arange(step + high)
    head = bounds[:, None] - 1 - np.arange(step)
    tail = bounds[:, None] + high - 2 - np.arange(high - low + step - 1)
    beyond = -2 - np.arange(ahead.shape[1])
    right = np.where(ahead < n, tile[np.minimum(ahead, n - 1)], beyond)
    before = np.where(head >= 0, tile[np.maximum(head, 0)], -2)
    after = np.where((tail >= 0) & (tail < n), tile[np.clip(tail, 0, n - 1)], -3)
    return right, np.concatenate([before, np.full((len(bounds), 1), -1), after], 1)


def tile_fragments(tiles: list[tuple[np.ndarray, int]], low: int, high: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(tile, period, start, end) of stretches of places i with word i equal to word i + period, for tiles of an octave.

    ``tiles``: (numbers, first boundary). A stretch goes on for a step at some boundary; there it is seen a step either
    way, so that stretches of neighbouring boundaries and tiles meet and become one, here or when they are stitched.
    """
    held, size = [], 0

    def solve():
        owner = np.concatenate([np.full(len(b), t) for t, b, _, _ in held])
        bounds = np.concatenate([b for _, b, _, _ in held])
        right = np.minimum(z_functions(np.concatenate([r for _, _, r, _ in held]))[:, low:high], step)
        left = z_functions(np.concatenate([x for _, _, _, x in held]))[:, step + 1 : step + 1 + high - low][:, ::-1]
        # a stretch's last words, less than a step, are seen from the boundary where they begin
        b, p = np.nonzero((right >= step) | (right > 0) & (left >= step))
        return owner[b], p + low, bounds[b] - left[b, p], bounds[b] + right[b, p]

    for t, (tile, first_bound) in enumerate(tiles):
        hits = first_bound + _hits(_mixed(tile[first_bound:]), np.array([0, len(tile) - first_bound]), low, high, step)
        bounds = np.unique(np.append(hits, hits + step))
        bounds = bounds[bounds + low < len(tile)]
        tile = tile.astype(np.int64)
        a_time = max(1, LANE_WORDS // (4 * high))
        for k in range(0, len(bounds), a_time):
            held.append((t, bounds[k : k + a_time], *_lanes(tile, bounds[k : k + a_time], low, high, step)))
            size += len(held[-1][1]) * 4 * high
            if size >= LANE_WORDS:
                yield solve()
                held, size = [], 0
    if held:
        yield solve()


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a group that meet or overlap, as one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((end, start, group))
    group, start, end = group[order], start[order], end[order]
    far = group * (int(end.max()) + 2) + end
    reach = np.maximum.accumulate(far)
    new = np.append(True, (group[1:] != group[:-1]) | (group[1:] * (int(end.max()) + 2) + start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(group)) - 1
    return group[at], start[at], reach[last] - group[at] * (int(end.max()) + 2)


def _numbers(raw: bytes) -> np.ndarray:
    kind = (np.uint16, np.uint32)[raw[0]]
    return np.frombuffer(raw, kind, offset=4)


def _solve(batches):
    for batch in batches:
        rows, bases, lows, ids = (batch.column(c).to_pylist() for c in ("row", "base", "low", "ids"))
        for low in sorted(set(lows)):
            own = [k for k, x in enumerate(lows) if x == low]
            high, step = (2 * FIRST, FIRST) if low == 1 else (2 * low, low)
            base, row = np.array([bases[k] for k in own]), np.array([rows[k] for k in own])
            tiles = [(_numbers(ids[k]), step if bases[k] else 0) for k in own]
            for tile, period, start, end in tile_fragments(tiles, low, high, step):
                group, start, end = merged(tile * high + period, start, end)
                tile, period = group // high, group % high
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (row[tile], period, start + base[tile], end + base[tile])], ["row", "period", "start", "end"])


_OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, listing string, collapsed string, plain_sha256 string"


def _cut(batches):
    """Adds the listing of the runs and the words that no run repeats, joined again."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.string()] * 3, strict=True)], [c.split()[0] for c in _OUT.split(", ")])

    for batch in batches:
        rows, size = [], 0
        for k in range(len(batch)):
            r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            listing = collapsed = None
            if r["n_runs"]:
                own = r["words"].encode().split()
                gone = np.zeros(len(own) + 1, np.int64)
                for a, n, p in zip(r["starts"], r["lengths"], r["periods"], strict=True):
                    gone[a + p] += 1
                    gone[a + n] -= 1
                listing = "".join(f"{a},{n},{p}\n" for a, n, p in zip(r["starts"], r["lengths"], r["periods"], strict=True))
                collapsed = b" ".join(own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()).decode()
                size += len(listing) + len(collapsed)
            rows.append((r["doc_id"], r["n_words"], r["n_runs"] or 0, r["start"], r["length"], r["period"], r["exponent_milli"], listing, collapsed, r["plain"]))
            if size > 64 << 20:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)


def periodic_runs(fragments: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(row, start, length, period): maximal runs from the fragments (row, period, start, end) of tiles, stitched by Spark.

    A stretch that also repeats with a part of its period shows up at both, with the same ends: the smallest period stays.
    """
    own = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(own)
    whole = fragments.withColumn("before", before).withColumn("island", island).groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    long = whole.select("row", "start", length.alias("length"), "period").filter(F.col("length") >= F.greatest(F.lit(least_words), least_times * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_runs, start, length, period, exponent_milli, listing, collapsed, plain_sha256.

    A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no neighbouring word
    extends; start, length, period and floor(1000 length / period) are those of the run with the greatest length over
    period (ties: the smaller start, then period), null without runs. ``listing`` has a line ``start,length,period`` a
    run, by start, then period; ``collapsed`` are the words that lie in no run after its first q words, joined by one
    space. Both are null where a document has no runs, and ``plain_sha256`` is then the digest of its words joined by
    one space (always given). Null and empty texts have no words and no runs. Rows that repeat, or share a doc_id or
    have none, each answer for themselves. A very long text is tiled like any other, and its tiles go to all tasks. An
    empty table gives an empty one; other columns, whatever their names, are not read.
    """
    prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = stored(small.mapInArrow(_scan(fresh_seed()), _DOC), "tiles")
    tiles = scanned.filter("kind = 1").select("row", "base", "low", "ids")
    size = tiles.agg(F.sum(F.length("ids"))).first()[0] or 0
    tiles = tiles.repartition(max(1, -(-size // TASK_BYTES)), "row", "low", "base")
    fragments = tiles.mapInArrow(_solve, "row long, period long, start long, end long")
    runs = periodic_runs(fragments)
    better = F.struct((F.col("length") / F.col("period")).alias("e"), (-F.col("start")).alias("s"), (-F.col("period")).alias("p"), F.col("length").alias("n"))
    listed = runs.groupBy("row").agg(F.count("*").alias("n_runs"), F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("all"), F.max(better).alias("best"))
    best = [(-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period")]
    of_row = listed.select("row", "n_runs", *best, *(F.col(f"all.{c}").alias(f"{c}s") for c in ("start", "length", "period")))
    of_row = of_row.withColumn("exponent_milli", F.expr("(1000 * length) div period"))
    held = scanned.filter("kind = 0").select("row", "doc_id", "n_words", "plain", "words")
    tiled = held.filter("words is not null").join(of_row, "row", "left").mapInArrow(_cut, _OUT)
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    texts = [F.lit(None).cast("string").alias(c) for c in ("listing", "collapsed")]
    return tiled.union(held.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), *none, *texts, F.col("plain").alias("plain_sha256")))
