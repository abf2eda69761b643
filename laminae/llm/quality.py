"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Evidence of a document is the log-odds of a small logistic model over a byte-trigram score and a few text statistics.
Sites then lend each other strength: a host's share of good documents shrinks toward the global prior, a path's toward
its host, by how many labelled (and, at part weight, unlabelled) documents they have and how much hosts and paths
really differ, which the data tell (moments). A document's posterior adds its evidence to its path's posterior, from
which its own label has been taken out.

Sites are summed by grouped aggregation, before anything is shuffled; no group is ever collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .grams import pieces, word_hashes, words_of

FEATURES = 1 << 16
#: Parts of the table of counts, summed by a task each.
CHUNKS = 64
#: Labelled documents that fit the classifier at most, dealt by hash; priors and sites use all labels.
FIT_DOCS = 20_000
#: Weight of an unlabelled document's classifier odds, against a label, in its site's share.
SOFT = 0.25
#: Documents' own evidence is capped so that no single one overrides any site.
_LIMIT = 12.0
#: Names of the statistics, in order.
STATISTICS = ("bias", "trigram", "log_words", "word_bytes", "mark_share", "digit_share", "capital_share", "line_words", "distinct_words")


def _grams(piece) -> tuple[np.ndarray, np.ndarray]:
    data = piece.data.astype(np.uint32)
    owner = np.repeat(np.arange(len(piece.ids)), np.diff(piece.offsets))
    keep = owner[2:] == owner[:-2]
    grams = ((data[:-2] << 16) | (data[1:-1] << 8) | data[2:])[keep]
    return ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), owner[:-2][keep]


def _count(batches):
    total = np.zeros((2, FEATURES))
    seen = False
    for batch in batches:
        good = np.asarray(batch.column("good")).astype(np.int64)
        for piece in pieces(batch, "doc_id", "text"):
            if len(piece.data) > 2:
                seen = True
                grams, owner = _grams(piece)
                weight = 1 / np.maximum(np.bincount(owner, minlength=len(piece.ids)), 200)
                own = good[piece.first_row : piece.first_row + len(piece.ids)][owner]
                total += np.bincount(own * FEATURES + grams, weights=weight[owner], minlength=2 * FEATURES).reshape(2, -1)
    if seen:
        parts = total.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts])], ["chunk", "counts"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(raw)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()])], ["chunk", "counts"])


def trigram_weights(labelled: DataFrame) -> np.ndarray:
    """Log-odds of each hashed trigram between good and bad documents; each document weighs one at most."""
    rows = labelled.mapInArrow(_count, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(_add, "chunk int, counts binary").collect()
    if not rows:
        return np.zeros(FEATURES, np.float32)
    counts = np.concatenate([np.frombuffer(r["counts"]) for r in sorted(rows, key=lambda r: r["chunk"])]).reshape(2, -1)
    shares = (counts + 1e-5) / (counts.sum(1, keepdims=True) + 1e-5 * FEATURES)
    return (np.log(shares[1]) - np.log(shares[0])).astype(np.float32)


def statistics(piece, weights: np.ndarray) -> np.ndarray:
    """(documents, len(STATISTICS)) features of whole texts."""
    n = len(piece.ids)
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = 1
    sizes = np.diff(piece.offsets)
    if not len(piece.data):
        return out
    owner = np.repeat(np.arange(n), sizes)
    words = words_of(piece)
    counts = np.diff(words.first)
    if len(piece.data) > 2:
        grams, of = _grams(piece)
        out[:, 1] = np.bincount(of, weights=weights[grams], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    data = piece.data
    share = lambda mask: np.bincount(owner, weights=mask, minlength=n) / np.maximum(sizes, 1)
    out[:, 2] = np.log1p(counts)
    out[:, 3] = sizes / np.maximum(counts, 1)
    out[:, 4] = share(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127)))
    out[:, 5] = share((data > 47) & (data < 58))
    out[:, 6] = share((data > 64) & (data < 91))
    out[:, 7] = np.log1p(counts / (1 + np.bincount(owner, weights=data == 10, minlength=n)))
    hashes = word_hashes(piece, words, fold_case=True)
    of_word = np.repeat(np.arange(n), counts)
    order = np.lexsort((hashes, of_word))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1]))[: len(order)]
    out[:, 8] = np.bincount(of_word[order], weights=new, minlength=n) / np.maximum(counts, 1)
    return out


def _features(handle):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "doc_id", "text"):
                rows = statistics(piece, handle.value)
                good = batch.column("good").slice(piece.first_row, len(piece.ids))
                yield pa.RecordBatch.from_arrays([good, pa.array(list(rows), pa.list_(pa.float64()))], ["good", "features"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, coefficients) of a ridge logistic regression by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    centre[0], scale[0] = 0, 1
    z = (x - centre) / scale
    beta = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, beta


def _evidence(handle):
    def run(batches):
        weights, centre, scale, beta = handle.value
        for batch in batches:
            logits = []
            for piece in pieces(batch, "doc_id", "text"):
                logits.append(np.clip((statistics(piece, weights) - centre) / scale @ beta, -_LIMIT, _LIMIT))
            values = np.concatenate(logits) if logits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(values)], ["doc_id", "host", "path", "evidence"])

    return run


def _strength(stats: DataFrame, prior: str) -> float:
    """Prior weight, in documents, from how much groups' shares vary beyond chance (method of moments)."""
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(prior), 2))
    chance = F.sum(F.col(prior) * (1 - F.col(prior)))
    row = stats.filter("n > 0").agg(spread.alias("s"), chance.alias("c"), F.sum("n").alias("n"), F.avg(F.col(prior) * (1 - F.col(prior))).alias("v")).first()
    if not row["n"]:
        return 10.0
    between = max((row["s"] - row["c"]) / row["n"], 1e-6)
    return float(min(max(row["v"] / between - 1, 1.0), 1e4))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, quality (0 to 1), keep, evidence, host_posterior, path_posterior.

    ``labels`` has ``id_col`` and a 0/1 ``label_col``; a document with several labels takes their maximum, null ones
    are ignored. ``host`` and ``path`` are columns or SQL expressions of ``docs``; null is a site of its own. Null or
    empty texts have the evidence of an empty text; very long texts are read whole. Without labels the prior is one half
    and all documents are kept. At most FIT_DOCS labelled rows fit the classifier. A document's evidence, in log-odds,
    is limited to -12 to 12 (_LIMIT).
    Repeated rows count each for their site and get equal results; an empty table gives an empty one; other columns,
    whatever their names, are not read.
    """
    spark = prepare(docs)
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("mark")).filter("_id is not null and mark is not null")
    marks = marks.groupBy("_id").agg((F.max("mark") > 0).cast("int").alias("good"))
    site = F.coalesce(F.expr(host).cast("string"), F.lit(""))
    part = F.coalesce(F.expr(path).cast("string"), F.lit("")) if path else F.lit("")
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), site.alias("host"), part.alias("path"))
    sizes = marks.agg(F.count("*").alias("n"), F.avg("good").alias("share")).first()
    share = min(max(sizes["share"] if sizes["n"] else 0.5, 1e-3), 1 - 1e-3)
    # FIT_DOCS small rows at most, so they are broadcast and no text is moved
    chosen = F.broadcast(marks.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(FIT_DOCS))
    labelled = small.join(chosen, small["doc_id"] == chosen["_id"]).select("doc_id", "text", "good")
    weights = trigram_weights(labelled)
    handle = spark.sparkContext.broadcast(weights)
    rows = labelled.mapInArrow(_features(handle), "good int, features array<double>").collect()
    if rows and 0 < sizes["share"] < 1:
        model = fit_logistic(np.array([r["features"] for r in rows]), np.array([r["good"] for r in rows], float))
    else:
        model = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.append(np.log(share / (1 - share)), np.zeros(len(STATISTICS) - 1))
    fitted = spark.sparkContext.broadcast((weights, *model))
    evidence = stored(small.mapInArrow(_evidence(fitted), "doc_id long, host string, path string, evidence double"), "evidence")
    scored = evidence.join(marks, evidence["doc_id"] == marks["_id"], "left").drop("_id")
    odds = 1 / (1 + F.exp(-F.col("evidence")))
    weight = F.when(F.col("good").isNull(), SOFT).otherwise(1.0)
    outcome = F.coalesce(F.col("good").cast("double"), odds)
    scored = scored.select("*", weight.alias("w"), (weight * outcome).alias("y"))
    paths = scored.groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum("y").alias("good")).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    prior = min(max(whole["good"] / whole["n"], 1e-3), 1 - 1e-3) if whole["n"] else 0.5
    host_weight = _strength(hosts.withColumn("prior", F.lit(prior)), "prior")
    shrunk = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + host_weight * prior) / (F.col("n") + host_weight)).alias("host_share"))
    sites = paths.join(shrunk, paths["host"] == shrunk["h"]).drop("h")
    path_weight = _strength(sites, "host_share")
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good")
    out = scored.join(sites, (scored["host"] == sites["h"]) & (scored["path"] == sites["p"]))
    # the document's own part is taken out of its sites
    host_posterior = (F.col("host_good") - F.col("y") + host_weight * prior) / (F.col("host_n") - F.col("w") + host_weight)
    out = out.withColumn("host_posterior", host_posterior)
    out = out.withColumn("path_posterior", (F.col("path_good") - F.col("y") + path_weight * F.col("host_posterior")) / (F.col("path_n") - F.col("w") + path_weight))
    base = float(np.log(share / (1 - share)))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") - base + _logit(F.col("path_posterior")))))
    return out.select("doc_id", posterior.alias("quality"), (posterior >= 0.5).alias("keep"), "evidence", "host_posterior", "path_posterior")
