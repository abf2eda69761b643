"""Nearest neighbours by inner product: multiprobe p-stable hashing, exact distances among what the probes find.

Vectors are scaled to the ball of the longest and lifted onto the sphere, so that the largest inner product is the
smallest Euclidean distance, which p-stable hashing serves: a table projects on Gaussian directions and cuts each
projection into slots of one width. A query visits the slots around its own in order of estimated success, table by
table, until the estimated chance to have met a neighbour reaches what the table owes; there is no cap on probes.

Vectors that are equal are one candidate with its smallest ids. A table's buckets are grouped by the first of their
slots; a group of many vectors or many probes is a grid of blocks, so no task holds more than a block of vectors and a
batch of probes, whatever the largest group of near copies. Partial lists merge by query. A query whose probes meet
fewer vectors than it asks for is searched once more over all of them.

The number of slots a bucket has follows the number of vectors; widths, spread and the distance to expect come from a
bounded sample (FIT_VECTORS), recall is measured against brute force in tests.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored
from .grams import grouped

#: Vectors, by hash of their ids, that slots and distances are fitted on at most.
FIT_VECTORS = 4096
TABLES = 4
#: Chance to meet a neighbour that all tables together are to reach by estimate.
GOAL = 0.975
#: Width of a slot, in standard deviations of a projection.
WIDTH = 2.0
#: Vectors that a bucket of the finest cut holds, about; slots a projection cuts off, in bits.
A_BUCKET, BITS = 64, 1.4
#: Slots of a bucket that are not part of its group's key.
INNER = 6
BLOCK_VECTORS, BLOCK_PROBES = 8192, 4096
#: Probes of a query tried at first; twice as many whenever the estimate stays short.
FIRST_PROBES = 256
_ROW = "tab int, grp long, vblock int, qblock int, kind int, id long, vector binary, more binary"
_PART = "query_id long, ids binary, scores binary"


class Tables(NamedTuple):
    """Projections of all tables, and what tells how far a neighbour's projection is from the query's."""

    directions: np.ndarray  # (tables, dims + 1, slots)
    shifts: np.ndarray  # (tables, slots)
    centre: np.ndarray
    scale: float  # the longest vector's length
    likeness: float  # correlation of a query's and a neighbour's projections
    owed: float  # estimated chance that a table is to reach


def _lifted(vectors: np.ndarray, scale: float) -> np.ndarray:
    own = vectors / scale
    return np.concatenate([own, np.sqrt(np.maximum(1 - (own * own).sum(1, keepdims=True), 0))], 1)


def _asked(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))], 1)


def fit(sample: np.ndarray, n: int, scale: float, k: int, seed: int, tables: int = TABLES) -> Tables:
    """Tables for ``n`` vectors; the spread of inner products is that between quartiles, so groups of copies leave it."""
    slots = max(0, round(math.log2(max(n, 1) / A_BUCKET) / BITS))
    made = np.random.default_rng(seed)
    lifted = _lifted(sample, scale)
    centre = lifted.mean(0)
    own = lifted - centre
    half = len(own) // 2
    pairs = (own[:half] @ own[half : 2 * half].T).ravel() if half else np.zeros(1)
    low, middle, high = np.quantile(pairs, [0.25, 0.5, 0.75])
    power = max(float((own * own).sum(1).mean()), 1e-12)
    spread = max((high - low) / 1.349, 1e-9)
    rare = min(k / max(n, 2), 0.5)
    likeness = min(max((middle + spread * NormalDist().inv_cdf(1 - rare)) / power, 0.05), 0.95)
    directions = made.standard_normal((tables, lifted.shape[1], slots))
    for t in range(tables):  # orthogonal ones among those of a table, as far as there are dimensions
        whole = slots // lifted.shape[1] * lifted.shape[1]
        for at in (*range(0, whole, lifted.shape[1]), whole):
            part = directions[t, :, at : min(at + lifted.shape[1], slots)]
            if part.shape[1]:
                part[:] = np.linalg.qr(part)[0]
    spreads = np.sqrt(np.maximum(((own @ directions) ** 2).mean(1, keepdims=True), 1e-18))
    return Tables(directions / spreads, made.uniform(0, WIDTH, (tables, slots)), centre, scale, likeness, 1 - (1 - GOAL) ** (1 / tables))


def _chance(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, to seven places (Abramowitz and Stegun, 26.2.17; fixed values)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def _coded(slots: np.ndarray) -> np.ndarray:
    """A number for each row of slots, mixed step by step, so that prefixes number groups."""
    code = np.zeros(slots.shape[:-1], np.uint64)
    for j in range(slots.shape[-1]):
        code = _next(code, slots[..., j])
    return code


def _next(code: np.ndarray, slot: np.ndarray) -> np.ndarray:
    code = (code ^ slot.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return code ^ (code >> np.uint64(29))


def buckets_of(tables: Tables, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, bucket) of every vector in a table."""
    slots = np.floor(((_lifted(vectors, tables.scale) - tables.centre) @ tables.directions[t] + tables.shifts[t]) / WIDTH)
    outer = max(0, slots.shape[1] - INNER)
    group = _coded(slots[:, :outer])
    code = group
    for j in range(outer, slots.shape[1]):
        code = _next(code, slots[:, j])
    return group.view(np.int64), code.view(np.int64)


def probes_of(tables: Tables, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, group, bucket) of all probes of a table, the likeliest of each query first.

    Slots are ordered by the chance of a neighbour as far off as expected, all directions alike; when to stop is told by
    the chance given that projections of neighbours lie nearer to the middle than the query's own.
    """
    own = (_asked(vectors) - tables.centre) @ tables.directions[t]
    near = np.floor((own + tables.shifts[t]) / WIDTH)
    rho, off = tables.likeness, math.sqrt(2 - 2 * tables.likeness)
    steps = np.arange(-2, 3)
    todo, limit, out = np.arange(len(own)), FIRST_PROBES, []
    while len(todo):
        score, chance = np.ones((len(todo), 1)), np.ones((len(todo), 1))
        group, code = np.zeros((len(todo), 1), np.uint64), np.zeros((len(todo), 1), np.uint64)
        outer = max(0, own.shape[1] - INNER)
        whole = True
        for j in range(own.shape[1]):
            slots = near[todo, j : j + 1] + steps
            low, at = slots * WIDTH - tables.shifts[t, j], own[todo, j : j + 1]
            likely = _chance((low + WIDTH - at) / off) - _chance((low - at) / off)
            true = _chance((low + WIDTH - rho * at) / math.sqrt(1 - rho * rho)) - _chance((low - rho * at) / math.sqrt(1 - rho * rho))
            score, chance = ((a[:, :, None] * b[:, None, :]).reshape(len(todo), -1) for a, b in ((score, likely), (chance, true)))
            code = _next(code[:, :, None], np.broadcast_to(slots[:, None, :], (*code.shape, len(steps)))).reshape(len(todo), -1)
            group = np.repeat(group, len(steps), 1) if j >= outer else code
            if score.shape[1] > limit:
                whole = False
                best = np.argpartition(-score, limit - 1, 1)[:, :limit]
                score, chance, group, code = (np.take_along_axis(x, best, 1) for x in (score, chance, group, code))
        order = np.argsort(-score, 1, kind="stable")
        chance, group, code = (np.take_along_axis(x, order, 1) for x in (chance, group, code))
        upto = np.cumsum(chance, 1)
        done = (upto[:, -1] >= tables.owed) | whole
        visit = (upto - chance < tables.owed) & done[:, None]
        rows, cols = np.nonzero(visit)
        out.append((todo[rows], group[rows, cols].view(np.int64), code[rows, cols].view(np.int64)))
        todo, limit = todo[~done], limit * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), kind) for v in column]).astype(np.float64)


def _dealt(tables: Tables, ask: bool, kind: str):
    """Rows of the exchange: vectors to their bucket in each table, or queries to each group that their probes visit."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors, ids = _matrix(batch.column("vector"), kind), np.asarray(batch.column("id"))
            for t in range(len(tables.directions)):
                if ask:
                    row, group, code = probes_of(tables, vectors, t)
                    order = np.lexsort((code, group, row))
                    row, group, code = row[order], group[order], code[order]
                    cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))) if len(row) else np.zeros(0, np.int64)
                    ends = np.append(cuts[1:], len(row))
                    more = pa.array([code[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())
                    row, group = row[cuts], group[cuts]
                else:
                    row = np.arange(len(ids))
                    group, code = buckets_of(tables, vectors, t)
                    copies = batch.column("copies").to_pylist()
                    more = pa.array([c.tobytes() + x for c, x in zip(code, copies, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(group), pa.array(ids[row]), batch.column("vector").take(pa.array(row)), more], ["tab", "grp", "id", "vector", "more"])

    return run


def _top(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: the higher score, then the smaller id; an id counts once."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])) if len(row) else np.zeros(0, bool)
    row, ids, scores = row[fresh], ids[fresh], scores[fresh]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], scores[keep]


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order whatever rows stand beside."""
    return (left * right).sum(1)


def _lists(query: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(row)).tolist()
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()) for x in (ids, scores)]
    return pa.RecordBatch.from_arrays([pa.array(query[row[starts]]), *packed], ["query_id", "ids", "scores"])


def _searched(k: int, kind: str):
    """A block of vectors at a time, then its probes in batches: the best k of each query among the buckets it visits."""

    def run(batches):
        key = held = None
        for group, parts in grouped(_numbered(batches), "block"):
            for part in parts:
                kinds = np.asarray(part.column("kind"))
                cut = int(np.searchsorted(kinds, 1))
                if group != key:
                    key, held = group, []
                if cut:
                    held.append(part.slice(0, cut))
                if cut < len(part) and held:
                    if not isinstance(held, tuple):
                        held = _block(held, kind)
                    yield from _answers(held, part.slice(cut), k, kind)

    return run


def _numbered(batches):
    """Batches with a number for every block, in the order of the sorted rows, cut so that a batch stays small."""
    last, number = None, 0
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("tab", "grp", "vblock", "qblock")), strict=True))
        numbers = np.zeros(len(keys), np.int64)
        for k, key in enumerate(keys):
            number += key != last
            last = key
            numbers[k] = number
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *(batch.column(c) for c in ("kind", "id", "vector", "more"))], ["block", "kind", "id", "vector", "more"])


def _block(parts: list[pa.RecordBatch], kind: str) -> tuple:
    whole = pa.Table.from_batches(parts)
    more = whole.column("more").to_pylist()
    code = np.array([int.from_bytes(x[:8], "little", signed=True) for x in more])
    copies = [np.frombuffer(x, np.int64, offset=8) for x in more]
    order = np.argsort(code, kind="stable")
    sizes = np.array([len(c) for c in copies])[order]
    vectors = _matrix(whole.column("vector"), kind)[order]
    return code[order], vectors, np.concatenate([copies[i] for i in order]), np.cumsum(sizes) - sizes, sizes


def _answers(block: tuple, asked: pa.RecordBatch, k: int, kind: str):
    code, vectors, copies, first, sizes = block
    a_time = max(1, 4_000_000 // len(code))
    for at in range(0, len(asked), a_time):
        part = asked.slice(at, a_time)
        queries, ids = _matrix(part.column("vector"), kind), np.asarray(part.column("id"))
        probes = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("more")]
        row = np.repeat(np.arange(len(ids)), [len(p) for p in probes])
        probe = np.concatenate(probes)
        low, high = np.searchsorted(code, probe), np.searchsorted(code, probe, "right")
        some = high > low
        if not some.any():
            continue
        row, low, high = row[some], low[some], high[some]
        scores = np.full((len(ids), len(code)), -np.inf)
        order = np.argsort(low, kind="stable")
        row, low, high = row[order], low[order], high[order]
        cuts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(low)], strict=True):  # a bucket at a time
            rows, lo, hi = row[a:b], low[a], high[a]
            scores[rows, lo:hi] = queries[rows] @ vectors[lo:hi].T
        if len(code) > k:
            least = np.partition(scores, len(code) - k, 1)[:, len(code) - k]
            slack = 1e-9 * np.maximum(1, np.abs(least, where=np.isfinite(least), out=np.zeros(len(least))))
            r, c = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        else:
            r, c = np.nonzero(scores > -np.inf)
        exact = _products(queries[r], vectors[c])
        own = np.repeat(np.arange(len(r)), sizes[c])
        at_copy = np.repeat(first[c] - (np.cumsum(sizes[c]) - sizes[c]), sizes[c]) + np.arange(int(sizes[c].sum()))
        yield _lists(ids, *_top(r[own], copies[at_copy], exact[own], k))


def _merged(k: int):
    """Lists of one query, which stand together, to the best k."""

    def run(batches):
        for _, parts in grouped(batches, "query_id"):
            ids, scores = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for p in parts for x in p.column(c)]) for c, kind in (("ids", np.int64), ("scores", np.float64)))
            query = np.array([parts[0].column("query_id")[0].as_py()])
            row, ids, scores = _top(np.zeros(len(ids), np.int64), ids, scores, k)
            if len(row):
                yield _lists(query, row, ids, scores)

    return run


def _blocks(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Index rows and probes, dealt to blocks: a group with many of either is a grid, whose cells meet each block of both once."""
    sizes = index.groupBy("tab", "grp").agg(F.count("*").alias("nv")).join(asked.groupBy("tab", "grp").agg(F.count("*").alias("nq")), ["tab", "grp"])
    many = sizes.select("tab", "grp", F.ceil(F.col("nv") / BLOCK_VECTORS).cast("int").alias("vs"), F.ceil(F.col("nq") / BLOCK_PROBES).cast("int").alias("qs")).filter("vs > 1 or qs > 1")
    many = stored(many, "grid")

    def dealt(rows: DataFrame, kind: int, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        wide = rows.join(many, ["tab", "grp"], "left").fillna(1, ["vs", "qs"])
        cell = F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int").alias(own)
        wide = wide.select("tab", "grp", F.lit(kind).alias("kind"), "id", "vector", "more", cell, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other))
        return wide.select(*(c.split()[0] for c in _ROW.split(", ")))

    return dealt(index, 0, "vblock", "vs", "qblock", "qs").union(dealt(asked, 1, "qblock", "qs", "vblock", "vs"))


def _search(candidates: DataFrame, queries: DataFrame, tables: Tables, k: int, kind: str) -> DataFrame:
    kinds = "tab int, grp long, id long, vector binary, more binary"
    index, asked = candidates.mapInArrow(_dealt(tables, False, kind), kinds), queries.mapInArrow(_dealt(tables, True, kind), kinds)
    block = ["tab", "grp", "vblock", "qblock"]
    cells = _blocks(index, asked).repartition(*block).sortWithinPartitions(*block, "kind")
    parts = cells.mapInArrow(_searched(k, kind), _PART)
    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), _PART)


def nearest(vectors: DataFrame, k: int = 20, query: str = "vec_id % 20 = 0", id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 12) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with every row that ``query`` names, itself left out.

    ``query`` is a condition on the id column. Ranks start at 1; ties go to the smaller vec_id, and a row that shares its
    id with another counts as that other. Scores are inner products in doubles of the vectors as they are. Vectors that
    are null, empty, zero, or hold a null or a number that is not finite take no part, nor do rows with a null id; those
    of another length than most are of another space and take no part either (ties: the longer). Fewer than k others:
    all of them. An empty table gives an empty one; other columns, whatever their names, are not read.
    """
    spark = prepare(vectors)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    number = F.col(vector_col).cast("array<double>")
    good = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), number.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    kinds = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("long")).orderBy(F.desc("n"), F.desc("dims")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if kinds is None:
        return spark.createDataFrame([], out)
    # nulls are out, so a vector's bytes stand for it; -0.0 becomes 0.0
    rows = rows.filter(F.size("v") == kinds["dims"]).mapInArrow(_bytes(kind), "id long, vector binary")
    rows = stored(rows, "vectors")
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.dropDuplicates(["id", "vector"]).withColumn("turn", first).filter(F.col("turn") <= k + 1)
    copies = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vector", "ids"), "candidates")
    n = copies.count()
    chosen = copies.select("vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_VECTORS).collect()  # a bounded sample
    sample = np.stack([np.frombuffer(r["vector"], kind) for r in chosen]).astype(np.float64)
    tables = fit(sample, n, float(kinds["long"]), k, seed)
    candidates = copies.mapInArrow(_packed_copies, "id long, vector binary, copies binary")
    queries = rows.withColumnRenamed("id", id_col).filter(query).withColumnRenamed(id_col, "id").dropDuplicates(["id", "vector"])
    found = stored(_search(candidates, queries, tables, k + 1, kind), "found")
    total = min(k + 1, rows.select("id").distinct().count())
    short = queries.join(found.filter(F.length("ids") >= 8 * total).select(F.col("query_id").alias("id")), "id", "left_anti")
    if not short.isEmpty():
        all_of_them = fit(sample, 1, float(kinds["long"]), k, seed, 1)
        found = found.union(_search(candidates, short, all_of_them, k + 1, kind)).repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k + 1), _PART)
    return found.mapInArrow(_ranked(k), out)


def _bytes(kind: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([(np.asarray(v.values, kind) + 0.0).astype(kind).tobytes() for v in batch.column("v")], pa.binary())], ["id", "vector"])

    return run


def _packed_copies(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array([np.asarray(v.values, np.int64).tobytes() for v in batch.column("ids")], pa.binary())], ["id", "vector", "copies"])


def _ranked(k: int):
    def run(batches):
        for batch in batches:
            columns = [[], [], [], []]
            for query, ids, scores in zip(batch.column("query_id").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
                ids, scores = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(scores.as_buffer(), np.float64)
                others = np.flatnonzero(ids != query)[:k]
                for c, values in zip(columns, (np.full(len(others), query), np.arange(1, len(others) + 1, dtype=np.int32), ids[others], scores[others]), strict=True):
                    c.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["query_id", "rank", "vec_id", "score"])

    return run
