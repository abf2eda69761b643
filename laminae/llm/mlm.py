"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words: the commonest of the whole corpus have ids of their own, others share ids by their last three bytes.
A word that shares its id is predicted in one step more: its share of the id, from counts of all words of all documents,
which meet the documents' words in a join. So every distinct word has a probability of its own, at any corpus size;
the network's tables, and what a neighbour tells, are of fixed size.
The network adds a learned vector for each neighbour (two on either side, one table a place), applies tanh, and
predicts the token in two steps, its class and its place in the class, so a token costs two small softmaxes. The sum of
the log-probabilities of all tokens of a document, each given its neighbours only, is the document's score.

Training is data-parallel numpy: every partition trains a replica on a share of its own positions, replicas are
averaged by positions through a shuffle, and the next round starts from the average. The share is a stride over all
documents; the rounds' strides interleave, so every position trains once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .grams import Piece, pieces, run_starts, word_hashes, words_of

CLASSES, MEMBERS = 40, 40
TOKENS = CLASSES * MEMBERS
COMMON = 1344
PLACES = (-2, -1, 1, 2)
HIDDEN = 24
#: One position in so many trains, in each round another one: the rounds together train all.
STRIDE = 3
ROUNDS = STRIDE
BATCH = 8192
RATE = 0.15
CHUNK = 8192
PIECE_TOKENS = 1 << 17
#: Log-probabilities that a join sums are whole multiples of 1 / UNIT.
UNIT = 10**9
#: Scores before a softmax lie between plus and minus this.
_LIMIT = 40.0
_EDGE = TOKENS  # the neighbour beyond a document's end


class Network(NamedTuple):
    places: np.ndarray  # (4, TOKENS + 1, HIDDEN)
    bias: np.ndarray
    classes: np.ndarray  # (HIDDEN, CLASSES)
    class_bias: np.ndarray
    members: np.ndarray  # (CLASSES, HIDDEN, MEMBERS)
    member_bias: np.ndarray

    @classmethod
    def shapes(cls):
        return ((len(PLACES), TOKENS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS))

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return cls(*(rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 and s != (CLASSES, MEMBERS) else np.zeros(s, np.float32) for s in cls.shapes()))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Network:
        out, at = [], 0
        for s in cls.shapes():
            n = int(np.prod(s))
            out.append(values[at : at + n].reshape(s).astype(np.float32).copy())
            at += n
        return cls(*out)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of scores, in place, and its sum by row); scores are limited, so that neither over- nor underflows."""
    np.clip(x, -_LIMIT, _LIMIT, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    x, total = _exponentials(x)
    x /= total[:, None]
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place."""
    chosen = np.clip(x[np.arange(len(x)), at], -_LIMIT, _LIMIT)
    return chosen - np.log(_exponentials(x)[1])


def hidden(net: Network, around: np.ndarray) -> np.ndarray:
    total = np.take(net.places[0], around[0], 0)
    total += net.bias
    for k in range(1, len(PLACES)):
        total += np.take(net.places[k], around[k], 0)
    return np.tanh(total, out=total)


def log_probabilities(net: Network, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(token | neighbours) of each position, a batch at a time."""
    parts = [slice(at, at + BATCH) for at in range(0, len(tokens), BATCH)]
    return np.concatenate([_log_probabilities(net, tokens[part], around[:, part]) for part in parts]) if parts else np.zeros(0)


def _log_probabilities(net: Network, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    order = np.argsort(tokens // MEMBERS, kind="stable")
    tokens = tokens[order]
    state = hidden(net, around[:, order])
    group, member = np.divmod(tokens, MEMBERS)
    out = _log_share(state @ net.classes + net.class_bias, group)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        lo, hi = cuts[c], cuts[c + 1]
        if hi > lo:
            out[lo:hi] += _log_share(state[lo:hi] @ net.members[c] + net.member_bias[c], member[lo:hi])
    back = np.empty(len(tokens), np.float64)
    back[order] = out
    return back


def train_batch(net: Network, squares: Network, tokens: np.ndarray, around: np.ndarray) -> None:
    """One Adagrad step on the mean negative log-probability."""
    n = len(tokens)
    order = np.argsort(tokens // MEMBERS, kind="stable")
    tokens, around = tokens[order], around[:, order]
    state = hidden(net, around)
    group, member = np.divmod(tokens, MEMBERS)
    error = _softmax(state @ net.classes + net.class_bias)
    error[np.arange(n), group] -= 1
    grads = [None, None, *(np.zeros_like(p) for p in net[2:])]
    grads[2][:], grads[3][:] = state.T @ error / n, error.mean(0)
    down = error @ net.classes.T
    cuts = np.searchsorted(group, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        lo, hi = cuts[c], cuts[c + 1]
        if hi > lo:
            inner = _softmax(state[lo:hi] @ net.members[c] + net.member_bias[c])
            inner[np.arange(hi - lo), member[lo:hi]] -= 1
            grads[4][c], grads[5][c] = state[lo:hi].T @ inner / n, inner.sum(0) / n
            down[lo:hi] += inner @ net.members[c].T
    down *= (1 - state * state) / n
    grads[1] = down.sum(0)
    for value, square, grad in zip(net[1:], squares[1:], grads[1:], strict=True):
        square += grad * grad
        value -= RATE * grad / np.sqrt(square + 1e-8)
    columns = np.ascontiguousarray(down.T, np.float64)
    for value, square, near in zip(net.places, squares.places, around, strict=True):
        grad = np.stack([np.bincount(near, column, TOKENS + 1) for column in columns], 1).astype(value.dtype)
        square += grad * grad
        value -= RATE * grad / np.sqrt(square + 1e-8)


def shared_ids(piece: Piece, words) -> np.ndarray:
    """Ids by the last three bytes, which words outside the vocabulary have."""
    ends = word_hashes(piece, words._replace(starts=np.maximum(words.starts, words.ends - 3)), fold_case=True)
    return COMMON + (ends % np.uint64(TOKENS - COMMON)).astype(np.int64)


class Vocabulary:
    """Ids of word hashes: the commonest by rank, others by the hash of their last three bytes."""

    def __init__(self, common: np.ndarray):
        self.keys = np.sort(common)
        self.ids = np.argsort(common, kind="stable")

    def tokens(self, piece: Piece, words, hashes: np.ndarray) -> np.ndarray:
        ids = shared_ids(piece, words)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            ids[known] = self.ids[at[known]]
        return ids


def neighbours(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(4, n): the tokens at PLACES inside the same document, or the edge."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(PLACES), len(tokens)), _EDGE)
    for k, step in enumerate(PLACES):
        a, b = max(0, step), min(0, step)
        same = owner[a : len(owner) + b] == owner[-b : len(owner) - a]
        here = slice(-b, len(tokens) - a) if len(tokens) >= abs(step) else slice(0, 0)
        out[k, here] = np.where(same, tokens[a : len(tokens) + b], _EDGE) if len(tokens) >= abs(step) else out[k, here]
    return out


def _word_counts(batches):
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush():
        keys, shared, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys)
        starts = run_starts(keys[order])
        return pa.RecordBatch.from_arrays([pa.array(keys[order][starts].view(np.int64)), pa.array(shared[order][starts]), pa.array(np.add.reduceat(counts[order], starts))], ["word", "token", "n"])

    for batch in batches:
        for piece in pieces(batch, "doc_id", "text"):
            spans = words_of(piece)
            keys, at, counts = np.unique(word_hashes(piece, spans, fold_case=True), return_index=True, return_counts=True)
            own = spans._replace(starts=spans.starts[at], ends=spans.ends[at])
            held.append((keys, shared_ids(piece, own).astype(np.int32), counts))
            size += len(keys)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, token, n), stored: how often each distinct word stands in all documents, and the id it may share."""
    counts = docs.mapInArrow(_word_counts, "word long, token int, n long")
    return stored(counts.groupBy("word").agg(F.min("token").alias("token"), F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The COMMON commonest words; ties go to the smaller hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).select("word").collect()
    return Vocabulary(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def shares(counts: DataFrame, words: Vocabulary) -> DataFrame:
    """(word, share): log P(word | shared id) of words outside the vocabulary, in units of 1 / UNIT."""
    own = counts.sparkSession.createDataFrame([(k,) for k in words.keys.view(np.int64).tolist()], "word long")
    rest = counts.join(F.broadcast(own), "word", "left_anti")
    totals = rest.groupBy("token").agg(F.sum("n").alias("total"))  # TOKENS - COMMON rows at most
    return rest.join(F.broadcast(totals), "token").select("word", F.round(F.log(F.col("n") / F.col("total")) * UNIT).cast("long").alias("share"))


def _tokenise(words):
    """A row's tokens, two bytes each, and its words in shared ids with their counts."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "doc_id", "text", 1 << 19):
                spans = words_of(piece)
                hashes = word_hashes(piece, spans, fold_case=True)
                tokens = words.value.tokens(piece, spans, hashes)
                rows = batch.slice(piece.first_row, len(piece.ids))
                cuts = pa.py_buffer((2 * spans.first).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(piece.ids), [None, cuts, pa.py_buffer(tokens.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(np.diff(spans.first)), packed, *_shared_words(spans.first, hashes, tokens)], ["row", "doc_id", "n_tokens", "tokens", "words", "counts"])

    return run


_TOKENS = "row long, doc_id long, n_tokens long, tokens binary, words array<long>, counts array<int>"


def tokenised(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, doc_id, n_tokens, tokens, words, counts), stored: each row's ids, read by all rounds and by scoring."""
    handle = docs.sparkSession.sparkContext.broadcast(words)  # COMMON hashes
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_tokenise(handle), _TOKENS), "tokens")


def _positions(batches):
    """(rows, first token of each, tokens, neighbours) of about PIECE_TOKENS tokens at a time."""
    for batch in batches:
        counts = np.asarray(batch.column("n_tokens"))
        ends, row = np.cumsum(counts), 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PIECE_TOKENS, "right")))
            rows = batch.slice(row, stop - row)
            first = np.append(0, np.cumsum(counts[row:stop]))
            tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), "<u2").astype(np.int64)
            row = stop
            yield rows, first, tokens, neighbours(tokens, first)


def trained_positions(turn: int, n: int) -> np.ndarray:
    """Which of ``n`` positions train in a round, in the order of their training."""
    return np.random.default_rng(turn).permutation(np.arange(turn % STRIDE, n, STRIDE))


def _replica(start, turn: int):
    def run(batches):
        net = Network.from_flat(start.value)
        squares = Network(*(np.full_like(p, 1e-4) for p in net))
        seen = 0
        for _, _, tokens, around in _positions(batches):
            own = trained_positions(turn, len(tokens))
            for at in range(0, len(own), BATCH):
                some = own[at : at + BATCH]
                train_batch(net, squares, tokens[some], around[:, some])
            seen += len(own)
        if seen:
            values = net.flat()
            parts = range(0, len(values), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK for k in parts], pa.int32()), pa.array([float(seen)] * len(parts)), pa.array([values[k : k + CHUNK].tobytes() for k in parts], pa.binary())], ["chunk", "weight", "value"])

    return run


def _mean(batches):
    total: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    for batch in batches:
        for chunk, w, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "weight", "value")), strict=True):
            total[chunk] = total.get(chunk, 0) + w * np.frombuffer(raw, np.float32).astype(np.float64)
            weight[chunk] = weight.get(chunk, 0) + w
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(total[k] / weight[k]).astype(np.float32).tobytes() for k in total], pa.binary())], ["chunk", "value"])


def train(tokens: DataFrame) -> Network:
    """Rounds of replicas and averages over stored tokens."""
    context = tokens.sparkSession.sparkContext
    values = Network.fresh().flat()
    chunks = -(-len(values) // CHUNK)
    for turn in range(ROUNDS):
        start = context.broadcast(values)  # fixed size
        replicas = tokens.select("n_tokens", "tokens").mapInArrow(_replica(start, turn), "chunk int, weight double, value binary")
        rows = replicas.repartition(chunks, "chunk").mapInArrow(_mean, "chunk int, value binary").collect()  # one model
        if rows:
            values = np.concatenate([np.frombuffer(r["value"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])
    return Network.from_flat(values)


def _shared_words(first: np.ndarray, hashes: np.ndarray, tokens: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each document, its distinct words outside the vocabulary and how often each stands there."""
    at = np.flatnonzero(tokens >= COMMON)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    keys = hashes[at]
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(new)
    offsets = pa.array(np.searchsorted(owner[starts], np.arange(len(first))).astype(np.int32))
    counts = np.diff(np.append(starts, len(keys))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(keys[starts].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(counts))


def _score(model):
    def run(batches):
        for rows, first, tokens, around in _positions(batches):
            total = np.append(0, np.cumsum(log_probabilities(model.value, tokens, around)))[first]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "doc_id", "n_tokens")), pa.array(np.diff(total))], ["row", "doc_id", "n_tokens", "net"])

    return run


def pseudo_likelihood(docs: DataFrame, model: tuple[Network, Vocabulary] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, pll (sum of log-probabilities), mean_logprob.

    Trains on ``docs`` unless a model is given; the shares of words in shared ids are those of ``docs`` in any case.
    Words are runs of bytes other than space and tab to carriage return, lower-cased A-Z. Null or empty texts: no
    tokens, pll 0, mean null. Very long texts are scored whole; repeated rows and equal texts (ties) get equal scores,
    null ids stay null, an empty table gives an empty one; other columns are not read.
    """
    spark = prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = word_counts(small)
    words = model[1] if model else vocabulary(counts)
    tokens = tokenised(small, words)
    handle = spark.sparkContext.broadcast(model[0] if model else train(tokens))  # fixed size
    scored = tokens.select("row", "doc_id", "n_tokens", "tokens").mapInArrow(_score(handle), "row long, doc_id long, n_tokens long, net double")
    found = tokens.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    # whole numbers, so that the order of the sum does not matter
    # and the distinct words of a partition fit a hash table, so the words of all rows need no sort
    inside = found.join(shares(counts, words).hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("inside"))
    pll = F.col("net") + F.coalesce(F.col("inside") / UNIT, F.lit(0.0))
    both = scored.join(inside, "row", "left").select("doc_id", "n_tokens", pll.alias("pll"))
    return both.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
