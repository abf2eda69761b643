"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of word shingles. Shingles have one global
order, rarest first; if two documents link, then for every l the first n - ceil(percent n / 100) + l shingles of either
hold at least l common ones. Each document picks its own l: a longer prefix visits more postings but lets pass only
documents with more matches, so l is where visits plus expected verifications cost least. A pair that matches
min(l_a, l_b) times is verified on the whole sets, unless its sizes and what is left behind its last match rule it out.
The smaller of two sets that link shares more of itself, so its prefix counts only up to a shorter length.

Three stages, all over every document and whole texts:

1. Shingle hashes, of words hashed under a seed that each run draws, meet by hash range, packed in byte planes; a shingle seen once can match nothing and takes the front
   of the order, so only shared shingles return, and only documents that share ``percent`` of their set go on.
2. Documents with equal sets, by size and 128 bits of their shingles' hashes, become one class.
3. Links. First rounds of pivots: in a posting list, each member outside the list's largest component is paired with one
   of that component's pivots, so a list of thousands of near copies costs thousands of pairs, not millions; a pair is
   verified if its prefixes share as many tokens as the smaller l of the two. Then every pair of different components
   that is still possible is counted, list by list, and verified after l matches; pairs inside one component cannot
   change the result. Long lists are split into blocks of members, a task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_seed, keyed, prepare, stored, total_bytes
from .components import connected_components
from .grams import bucket_edges, bucket_of, exchanged, from_planes, grouped, levels, mix64, pieces, run_starts, runs, to_planes, window_hashes, word_hashes, words_of

BLOCK_SHINGLES = 1_000_000
BUCKET_BYTES = 8 << 20
PIVOT_ROUNDS = 4
#: Members of a list's largest component that others of the list are paired with in a round, at most.
PIVOTS = 64
#: Members of a list outside its largest component that one task pairs with the whole list.
LIST_BLOCK = 2000
#: A list with at least one in so many postings is broadcast, so at most so many are.
HOT_SHARE = 1000
#: Postings of a partition, at least, between the exchanges of the rounds: what is small does not go through every
#: partition of each, where a task's own files and records take more room than its rows.
PART_POSTINGS = 10_000
LONGEST_MULTI = 8
#: Words of 64 bits in a class's signature: the parity of its shared shingles by hash.
SIGNATURE_WORDS = 8
#: Kinds of cells: shingles that still have to meet, shingles known to be shared, and sizes of documents.
MEET, SHARED, SIZE = 0, 1, 2
_KEEP_BITS = np.uint64(0xFFFF_FFFF_FFFF_0000)
_CELL = "key int, kind int, docs binary, owners binary, hashes binary"
_CELL_ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("owners", pa.binary()), ("hashes", pa.binary())])
_SETS = "doc_id long, n_shingles long, set_hash long, set_check long, shared array<long>"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CELL_ARROW.types, strict=True)], schema=_CELL_ARROW)


def _cell(key: int, kind: int, ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> tuple:
    used, place = np.unique(owner, return_inverse=True)
    return key, kind, to_planes(ids[used]), to_planes(place.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)), to_planes(hashes)


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    hashes = from_planes(row["hashes"], np.uint64)
    owners = from_planes(row["owners"], np.uint16 if len(row["owners"]) == 2 * len(hashes) else np.uint32)
    return from_planes(row["docs"], np.int64)[owners], hashes


def _blocks(batches: Iterator[pa.RecordBatch], width: int, seed: int):
    held, size, base = [], 0, 0
    for batch in batches:
        for piece in pieces(batch, "doc_id", "text"):
            words = words_of(piece)
            hashes, rows, _ = window_hashes(word_hashes(piece, words, fold_case=True, seed=seed), words.first, width, short_too=True)
            held.append((piece.ids, hashes, rows + base))
            base += len(piece.ids)
            size += len(hashes)
            if size >= BLOCK_SHINGLES:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size, base = [], 0, 0
    if base:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) in the order of hashes, each once."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[fresh], owner[fresh]


def _deal(ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray, buckets: int, turn: int):
    """A block's cells: shingles that several of its documents hold, and one entry of each shingle by hash range."""
    starts = run_starts(hashes)
    lengths = np.diff(np.append(starts, len(hashes)))
    many = np.repeat(lengths > 1, lengths)
    if many.any():
        yield _table([_cell((turn * 6101) % buckets, SHARED, ids, owner[many], hashes[many])])
    hashes, owner = hashes[starts], owner[starts]
    full, cuts = bucket_edges(hashes, buckets)
    rows, held = [], 0
    for bucket, lo, hi in zip(full.tolist(), cuts[:-1], cuts[1:], strict=True):
        rows.append(_cell(bucket, MEET, ids, owner[lo:hi], hashes[lo:hi]))
        held += hi - lo
        if held > 250_000:
            yield _table(rows)
            rows, held = [], 0
    if rows:
        yield _table(rows)


def _set_sums(sizes: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """128 bits of each set: sums of two mixes of its shingles' hashes, one after the other."""
    sums = np.zeros((2, sizes), np.uint64)
    for k, salt in enumerate((0x5DEECE66D, 0x9FB21C651E98DF25)):
        np.add.at(sums[k], owner, mix64(hashes ^ np.uint64(salt)))
    return sums.reshape(-1)


def _scan(width: int, buckets: int, seed: int):
    def run(batches):
        for turn, (ids, hashes, owner) in enumerate(_blocks(batches, width, seed)):
            hashes, owner = _distinct(hashes, owner)
            sizes = np.bincount(owner, minlength=len(ids)).astype(np.uint32)
            # sizes travel in the owners' column, with the ids in their own order, two sums a document in the hashes'
            yield _table([((turn * 7919) % buckets, SIZE, to_planes(ids), to_planes(sizes), to_planes(_set_sums(len(ids), owner, hashes)))])
            yield from _deal(ids, *_distinct(hashes & _KEEP_BITS, owner), buckets, turn)

    return run


def _deal_again(buckets: int):
    """Cells of wide ranges to cells of narrow ones, a block of shingles at a time."""

    def run(batches):
        held, size, turn = [], 0, 0

        def flush():
            docs, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
            ids, owner = np.unique(docs, return_inverse=True)
            return _deal(ids, *_distinct(hashes, owner), buckets, turn)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != MEET:
                    turn += 1
                    yield _table([((turn * 7919) % buckets, *list(row.values())[1:])])
                    continue
                held.append(_read(row))
                size += len(held[-1][1])
                if size >= BLOCK_SHINGLES:
                    yield from flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield from flush()

    return run


def _shards(docs: np.ndarray, shards: int) -> np.ndarray:
    return bucket_of(mix64(docs.astype(np.uint64)), shards)


def _sharded(docs: np.ndarray, hashes: np.ndarray, shards: int):
    shard = _shards(docs, shards)
    order = np.lexsort((docs, shard))
    docs, hashes, shard = docs[order], hashes[order], shard[order]
    rows = []
    for lo, hi in runs(shard):
        owner = np.cumsum(np.append(False, docs[lo + 1 : hi] != docs[lo : hi - 1]))
        rows.append(_cell(int(shard[lo]), SHARED, docs[lo:hi][run_starts(docs[lo:hi])], owner, hashes[lo:hi]))
    if rows:
        yield _table(rows)


def _sizes(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, two sums of each) of a cell of sizes."""
    ids = from_planes(row["docs"], np.int64)
    return ids, from_planes(row["owners"], np.uint32), from_planes(row["hashes"], np.uint64).reshape(2, -1)


def _sharded_sizes(row, shards: int):
    ids, sizes, sums = _sizes(row)
    shard = _shards(ids, shards)
    order = np.argsort(shard, kind="stable")
    ids, sums, sizes, shard = ids[order], sums[:, order], sizes[order], shard[order]
    rows = [(int(shard[lo]), SIZE, to_planes(ids[lo:hi]), to_planes(sizes[lo:hi]), to_planes(np.ascontiguousarray(sums[:, lo:hi]).reshape(-1))) for lo, hi in runs(shard)]
    if rows:
        yield _table(rows)


def _shard_again(shards: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == SIZE:
                    yield from _sharded_sizes(row, shards)
                    continue
                held.append(_read(row))
                size += len(held[-1][1])
                if size >= BLOCK_SHINGLES:
                    yield from _sharded(*(np.concatenate(c) for c in zip(*held, strict=True)), shards)
                    held, size = [], 0
        if held:
            yield from _sharded(*(np.concatenate(c) for c in zip(*held, strict=True)), shards)

    return run


def _match(shards: int):
    def run(batches):
        for _, held in grouped(batches, "key"):
            docs, hashes = [], []
            for part in held:
                for row in part.to_pylist():
                    if row["kind"] == SIZE:
                        yield from _sharded_sizes(row, shards)
                    elif row["kind"] == SHARED:
                        yield from _sharded(*_read(row), shards)
                    else:
                        d, h = _read(row)
                        docs.append(d)
                        hashes.append(h)
            if docs:
                docs, hashes = np.concatenate(docs), np.concatenate(hashes)
                order = np.argsort(hashes)
                docs, hashes = docs[order], hashes[order]
                starts = run_starts(hashes)
                lengths = np.diff(np.append(starts, len(hashes)))
                many = np.repeat(lengths > 1, lengths)
                yield from _sharded(docs[many], hashes[many], shards)

    return run


def _gather(percent: int):
    """Per document: size, hash of the set, and, if enough of it is shared, its shared shingles."""

    def run(batches):
        for _, held in grouped(batches, "key"):
            docs, hashes, meta = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
            for part in held:
                for row in part.to_pylist():
                    if row["kind"] == SIZE:
                        meta.append(_sizes(row))
                    else:
                        d, h = _read(row)
                        docs.append(d)
                        hashes.append(h)
            docs, hashes = np.concatenate(docs), np.concatenate(hashes)
            order = np.lexsort((hashes, docs))
            docs, hashes = docs[order], hashes[order]
            fresh = np.append(True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))[: len(docs)]
            docs, hashes = docs[fresh], hashes[fresh]
            ids, sizes, sums = (np.concatenate(c, -1) for c in zip(*meta, strict=True))
            lo, hi = np.searchsorted(docs, ids), np.searchsorted(docs, ids, "right")
            enough = (sizes > 0) & (100 * (hi - lo) >= percent * sizes.astype(np.int64))
            lengths = np.where(enough, hi - lo, 0)
            cuts = np.append(0, np.cumsum(lengths))
            take = np.arange(cuts[-1]) + np.repeat(lo - cuts[:-1], lengths)
            for at in range(0, len(ids), 500):
                part = slice(at, at + 500)
                window = cuts[at : at + 501]
                lists = pa.ListArray.from_arrays(pa.array((window - window[0]).astype(np.int32)), pa.array(hashes[take[window[0] : window[-1]]].view(np.int64)), mask=pa.array(~enough[part]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(sizes[part].astype(np.int64)), *(pa.array(x[part].view(np.int64)) for x in sums), lists], ["doc_id", "n_shingles", "set_hash", "set_check", "shared"])

    return run


def shingle_sets(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage 1: doc_id, n_shingles, set_hash, and the shared shingles of documents that may have partners."""
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    buckets = levels(max(16, -(-total_bytes(small, "text") // BUCKET_BYTES)))
    shards = levels(max(8, buckets[-1] // 2))
    cells = exchanged(small.mapInArrow(_scan(width, buckets[0], fresh_seed()), _CELL), "key", buckets[0])
    for more in buckets[1:]:
        cells = exchanged(cells.mapInArrow(_deal_again(more), _CELL), "key", more)
    found = exchanged(cells.mapInArrow(_match(shards[0]), _CELL), "key", shards[0])
    for more in shards[1:]:
        found = exchanged(found.mapInArrow(_shard_again(more), _CELL), "key", more)
    return stored(found.mapInArrow(_gather(percent), _SETS), "shingle-sets")


def _count_sets(width: int):
    def run(batches):
        for ids, hashes, owner in _blocks(batches, width, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(_distinct(hashes, owner)[1], minlength=len(ids)))], ["n_shingles"])

    return run


def _prefixes(percent: int):
    """Picks each class's l by estimated cost: rep, n, m, l, how many tokens count if it is the smaller of a pair, its
    signature, the length of its prefix, and all its tokens."""
    bits = 64 * SIGNATURE_WORDS

    def run(batches):
        for batch in batches:
            out = []
            for rep, n, ranked in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("ranked"), strict=True):
                postings = np.asarray(ranked.values.field("df"), dtype=np.float64)
                tokens = np.asarray(ranked.values.field("token"))
                m = len(tokens)
                need = (percent * n + 99) // 100
                # the smaller of two sets that link shares at least this much of itself
                need_smaller = (2 * percent * n + 99 + percent) // (100 + percent)
                multi = np.arange(1, min(need, LONGEST_MULTI) + 1)
                visits = np.cumsum(postings)[m - need + multi - 1]
                best = int(multi[np.argmin(visits + visits / multi * (n / 8))])
                odd = np.bincount((tokens.view(np.uint64) >> np.uint64(16)).astype(np.int64) % bits, minlength=bits) & 1
                signature = np.packbits(odd.astype(np.uint8)).view(np.int64)
                out.append((rep, n, m, best, max(0, m - need_smaller + best), signature, m - need + best, tokens))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rep", "n", "m", "multi", "short", "sig", "reach", "tokens"])

    return run


#: What a posting says of its class: set size, shared shingles, l, prefix as the smaller one, signature, the token's place.
_POSTING = ("rep", "n", "m", "multi", "short", "sig", "pos")


def _met(left: DataFrame, right: DataFrame, on, parts: int, how: str = "inner") -> DataFrame:
    """A join whose sides meet where they are dealt, in ``parts`` partitions; a broadcast would collect each one again."""
    return left.join(right.hint("merge"), on, how).coalesce(parts)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, parts: int, matched: bool = False) -> DataFrame:
    """Links among candidate pairs (a, b), on whole sets; first, unless they ``matched`` before, on their prefixes."""
    one, two = (sets.select(F.col("rep").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "multi", "reach", "tokens"))) for x in ("a", "b"))
    prefixes = [F.slice(f"{x}_tokens", 1, F.col(f"{x}_reach")) for x in ("a", "b")]
    enough = F.lit(True) if matched else F.size(F.array_intersect(*prefixes)) >= F.least("a_multi", "b_multi")
    common = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    linked = F.when(enough, (100 + percent) * common >= percent * (F.col("a_n") + F.col("b_n"))).otherwise(False)
    return _met(_met(pairs, one, "a", parts), two, "b", parts).filter(linked).select("a", "b")


def _possible(percent: int):
    """Column: postings a_*, b_* of one token may lead to a link, by sizes, what either shares at all, and signatures.

    A shingle that only one of them holds flips one bit, so their shared parts differ by as many shingles as bits at
    least. No pair that links fails; most near copies that do not link never leave the join.
    """
    shared = (100 + percent) * F.least("a_m", "b_m") >= percent * (F.col("a_n") + F.col("b_n"))
    apart = sum((F.bit_count(F.col("a_sig")[k].bitwiseXOR(F.col("b_sig")[k])) for k in range(SIGNATURE_WORDS)), F.lit(0))
    shared = shared & ((100 + percent) * (F.col("a_m") + F.col("b_m") - apart) >= 2 * percent * (F.col("a_n") + F.col("b_n")))
    counts = F.when(F.struct("a_n", "a_rep") < F.struct("b_n", "b_rep"), F.col("a_pos") < F.col("a_short")).otherwise(F.col("b_pos") < F.col("b_short"))
    return shared & counts


def _matching(pairs: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): pairs that match often enough in their prefixes and still can share enough behind them."""
    fields = ("rep", "n", "m", "multi", "pos")
    sides = [F.struct(*(F.col(f"{side}_{c}").alias(c) for c in fields)) for side in ("a", "b")]
    ahead = F.col("a_rep") < F.col("b_rep")
    pairs = pairs.select(F.when(ahead, sides[0]).otherwise(sides[1]).alias("x"), F.when(ahead, sides[1]).otherwise(sides[0]).alias("y"))
    pairs = pairs.select(*(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("x", "y") for c in fields))
    left = F.least(F.first("x_m") - F.max("x_pos"), F.first("y_m") - F.max("y_pos")) - 1
    bound = (100 + percent) * (F.count("*") + left) >= percent * (F.first("x_n") + F.first("y_n"))
    enough = F.count("*") >= F.least(F.first("x_multi"), F.first("y_multi"))
    met = pairs.groupBy(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).agg((bound & enough).alias("possible"))
    return met.filter("possible").select("a", "b")


def _relabel(labels: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """Components after more links; only components are joined, so the graph shrinks from round to round."""
    one = labels.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    named = _met(_met(links, one, "a", parts), two, "b", parts).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = connected_components(named, parts)
    return _met(labels, merged, labels["component"] == merged["node"], parts, "left").select("rep", F.coalesce(merged["component"], labels["component"]).alias("component")).checkpoint()


def _outside(postings: DataFrame, labels: DataFrame, least: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Postings (as a_*, with their component and their list's largest one) outside that component, and those of it.

    Only lists of two components or more count; the facts of lists of ``least`` postings or more are broadcast.
    """
    tagged = _met(postings, labels, "rep", parts)
    shares = tagged.groupBy("token", "component").agg(F.count("*").alias("k")).coalesce(parts)
    heads = shares.groupBy("token").agg(F.count("*").alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("top")).filter("parts > 1")
    heads = heads.select("token", (-F.col("top.c")).alias("largest"), F.col("top.k").alias("members"), F.ceil((F.col("all") - F.col("top.k")) / LIST_BLOCK).cast("int").alias("blocks"), "all").coalesce(parts)
    # lists of a thousandth of all postings, a thousand at most, are broadcast; their postings' key deals them out
    facts = ("largest", "members", "blocks")
    hot = F.broadcast(heads.filter(F.col("all") >= least).select(F.col("token").alias("_hot"), *(F.col(c).alias(f"hot_{c}") for c in facts)))
    cold = heads.filter(F.col("all") < least).select(F.col("token").alias("_cold"), *facts)
    seen = tagged.join(hot, tagged["token"] == hot["_hot"], "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("token")).otherwise(F.xxhash64("rep")))
    both = _met(seen, cold, (F.col("_key") == F.col("_cold")) & F.col("_hot").isNull(), parts, "left").filter("_hot is not null or _cold is not null")
    named = both.select("token", "component", *(F.coalesce(f"hot_{c}", c).alias(c) for c in facts), *(F.col(c).alias(f"a_{c}") for c in _POSTING))
    return named.filter("component <> largest"), named.filter("component = largest")


def _with_pivots(postings: DataFrame, labels: DataFrame, salt: int, least: int, parts: int) -> DataFrame:
    """Postings outside their list's largest component (a_*), each with one of up to PIVOTS members of it (b_*).

    Pivots are the members of least hash in each of a list's shares; which share a posting asks depends on itself, so
    over its lists a class meets many members of a component, at one pair a posting.
    """
    minor, major = _outside(postings, labels, least, parts)
    shares = F.least("members", F.lit(PIVOTS))
    turn = F.struct(F.xxhash64("a_rep", F.lit(salt)).alias("turn"), *(F.col(f"a_{c}").alias(c) for c in _POSTING))
    pivots = major.groupBy("token", F.pmod(F.xxhash64("a_rep", F.lit(salt + 100)), shares).alias("share")).agg(F.min(turn).alias("pivot"))
    pivots = pivots.select("token", "share", *(F.col(f"pivot.{c}").alias(f"b_{c}") for c in _POSTING)).coalesce(parts)
    asked = minor.withColumn("share", F.pmod(F.xxhash64("a_rep", "token", F.lit(salt)), shares))
    return _met(asked, pivots, ["token", "share"], parts)


def class_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stages 2 and 3: (classes: set_hash, set_check, n, rep; components: rep, component) of documents that may have partners."""
    members = sets.filter("shared is not null")
    classes = members.groupBy("set_hash", "set_check", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.min_by("shared", "doc_id").alias("tokens"))
    classes = stored(classes, "classes")
    tokens = classes.select("rep", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.floor((percent * F.col("n") + 99) / 100)
    ranked = tokens.join(counts, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked")).filter(F.size("ranked") >= need)
    whole = stored(ranked.mapInArrow(_prefixes(percent), "rep long, n long, m long, multi int, short int, sig array<long>, reach int, tokens array<long>"), "ranked")
    postings = stored(whole.select("rep", "n", "m", "multi", "short", "sig", F.posexplode(F.slice("tokens", 1, F.col("reach"))).alias("pos", "token")), "postings")
    many = postings.count()
    least, parts = max(2, -(-many // HOT_SHARE)), max(1, -(-many // PART_POSTINGS))
    labels = whole.select("rep", F.col("rep").alias("component")).checkpoint()
    for salt in range(PIVOT_ROUNDS):
        met = _with_pivots(postings, labels, salt, least, parts).filter(_possible(percent))
        pairs = met.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct().coalesce(parts)
        links = _verified(pairs, whole, percent, parts).checkpoint()
        if links.isEmpty():
            break
        labels = _relabel(labels, links, parts)
    minor, major = _outside(postings, labels, least, parts)
    # members of the largest component are met from the other side; two others meet once, in the order of components
    block = F.pmod(F.xxhash64("a_rep"), F.col("blocks")).cast("int")
    asking = minor.select("token", block.alias("block"), "component", *(f"a_{c}" for c in _POSTING))
    asked = minor.union(major).select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("component").alias("b_component"), (F.col("component") == F.col("largest")).alias("of_largest"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in _POSTING))
    crossing = (F.col("component") != F.col("b_component")) & (F.col("of_largest") | (F.col("component") < F.col("b_component")))
    pairs = asking.join(asked, ["token", "block"]).filter(crossing & _possible(percent))
    labels = _relabel(labels, _verified(_matching(pairs, percent), whole, percent, parts, matched=True).checkpoint(), parts)
    return classes.select("set_hash", "set_check", "n", "rep"), labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least doc_id with the same set), component_id.

    Words are lower-cased (A-Z only) runs of bytes other than space and tab to carriage return; a set holds the
    distinct ``width``-word shingles, or the whole sequence if a document has fewer words. Without words or text
    (null, empty): size 0, no links, a class and component of its own. Ties and copies: the least doc_id names the
    component. Repeated rows with one doc_id and text count as one document and each get the same result; a null
    doc_id gets its size and no class or component. Of rows with one doc_id and different texts each has a set of its
    own. Very long texts are read whole. An empty table gives an empty one; other columns are not read.
    """
    prepare(docs)
    rows, bits, names = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "key")
    sets = shingle_sets(rows, width, percent, "key", "text")
    classes, labels = class_links(sets, percent)
    same = ["set_hash", "set_check", "n_shingles"]
    named = classes.join(labels, "rep", "left").select("set_hash", "set_check", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    paired = sets.filter("shared is not null").select("doc_id", *same).join(named, same, "left")
    alone = sets.filter("shared is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    unnamed = docs.filter(F.col(id_col).isNull()).select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unnamed = unnamed.mapInArrow(_count_sets(width), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    named = paired.select("doc_id", "n_shingles", "class_id", "component_id").union(alone)
    result = named.select(F.shiftright("doc_id", bits).alias("doc_id"), "n_shingles", *(F.shiftright(c, bits).alias(c) for c in ("class_id", "component_id")))
    for c in ("doc_id", "class_id", "component_id") if names is not None else ():
        result = result.join(names.select(F.col("rank").alias(c), F.col("id").alias("named")), c).drop(c).withColumnRenamed("named", c)
    return result.select("doc_id", "n_shingles", "class_id", "component_id").union(unnamed)
