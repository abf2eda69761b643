"""Language identification by error-correcting output codes over byte n-grams.

Every learned language has a codeword; every bit has a binary classifier, a class-balanced log-odds score of byte
trigrams (with word borders) between the languages whose bit is one and the others. Decoding is loss-weighted: the
logistic losses of all bits, weighted by how well each bit separates training documents, add up for each codeword;
the nearest wins, and the distance to the next one says how ambiguous the text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .grams import pieces

FEATURES = 1 << 16
#: Documents of one language that training reads at most, dealt by hash; the only bound, and only on training.
TRAIN_DOCS_PER_LANGUAGE = 4000
#: Odds below which the nearest codeword does not stand out.
AMBIGUOUS = 0.6
_UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[:0x41] = 0x20  # digits, marks and white space are borders
_FOLD[[0x5B, 0x5C, 0x5D, 0x5E, 0x5F, 0x60, 0x7B, 0x7C, 0x7D, 0x7E, 0x7F]] = 0x20


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1/-1 codes, one row a language: all splits of few languages, well separated random ones of many."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        columns = [[1 if i == 0 or not (k + 1) >> (i - 1) & 1 else -1 for i in range(n)] for k in range(bits)]
        return np.array(columns, np.float32).T.reshape(n, bits)
    bits = int(np.ceil(15 * np.log2(n)))
    best, apart = None, -1
    for trial in range(200):
        codes = np.where(np.random.default_rng((seed, trial)).random((n, bits)) < 0.5, -1, 1).astype(np.float32)
        agree = codes @ codes.T - 2 * bits * np.eye(n)
        balanced = np.abs(codes.sum(0)) < n
        least = (bits - agree.max()) / 2 if balanced.all() else -1
        if least > apart:
            best, apart = codes, least
    return best


def _gram_ids(piece) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram of every byte position, document of each)."""
    folded = _FOLD[piece.data]
    owner = np.repeat(np.arange(len(piece.ids)), np.diff(piece.offsets))
    same = owner[2:] == owner[:-2]
    grams = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    blank = (folded[1:-1] == 0x20) & ((folded[:-2] == 0x20) | (folded[2:] == 0x20))
    keep = same & ~blank
    return ((grams[keep] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), owner[:-2][keep]


def _counts(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), FEATURES))
        seen = False
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for piece in pieces(batch, "doc_id", "text"):
                if len(piece.data) > 2:
                    seen = True
                    grams, owner = _gram_ids(piece)
                    # a document's grams add up to one at most, so that long texts do not outweigh the others
                    weight = 1 / np.maximum(np.bincount(owner, minlength=len(piece.ids)), 200)
                    own = lang[piece.first_row : piece.first_row + len(piece.ids)][owner]
                    total += np.bincount(own * FEATURES + grams, weights=weight[owner], minlength=total.size).reshape(total.shape)
        if seen:
            for i, x in enumerate(languages):
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([total[i].astype(np.float32).tobytes()])], ["lang", "counts"])

    return run


def _added(batches):
    """Sums of the count vectors of each language; one vector of fixed size for each language and task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[lang] = total.get(lang, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.float32).tobytes() for x in total.values()])], ["lang", "counts"])


class Model:
    def __init__(self, languages, codes, weights, bias, scale, trust):
        self.languages, self.codes, self.weights, self.bias, self.scale, self.trust = languages, codes, weights, bias, scale, trust

    def margins(self, piece) -> np.ndarray:
        """Mean log-odds of each bit over a document's n-grams."""
        out = np.zeros((len(piece.ids), self.codes.shape[1]))
        if len(piece.data) > 2:
            grams, owner = _gram_ids(piece)
            counts = np.bincount(owner, minlength=len(piece.ids))
            for bit in range(out.shape[1]):
                out[:, bit] = np.bincount(owner, weights=self.weights[bit][grams], minlength=len(piece.ids)) / np.maximum(counts, 1)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, odds of it against the runner-up, weighted losses)."""
        z = (margins - self.bias) * self.scale
        losses = np.stack([(np.logaddexp(0, -z * code) * self.trust).sum(1) for code in self.codes], 1)
        likely = np.exp(losses.min(1, keepdims=True) - losses)
        return losses.argmin(1), likely.max(1) / likely.sum(1), losses


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> Model | None:
    """A model of every language of the labelled ``rows``; at most about ``per_language`` documents of each train it."""
    spark = rows.sparkSession
    labelled = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    chosen = labelled.filter((F.xxhash64("doc_id", F.lit(11)).bitwiseAND(0xFFFFFF) / float(1 << 24)) < share[F.col("lang")])
    partial = chosen.mapInArrow(_counts(languages), "lang string, counts binary")
    summed = partial.repartition(min(len(languages), 64), "lang").mapInArrow(_added, "lang string, counts binary").collect()
    counts = np.full((len(languages), FEATURES), 0.0)
    for row in summed:
        counts[languages.index(row["lang"])] += np.frombuffer(row["counts"], np.float32)
    shares = (counts + 1e-3 / FEATURES * counts.sum(1, keepdims=True) + 1e-9) / (counts.sum(1, keepdims=True) * (1 + 1e-3) + 1e-9 * FEATURES)
    codes = codewords(len(languages))
    weights = np.zeros((codes.shape[1], FEATURES), np.float32)
    for bit, column in enumerate(codes.T):
        if (column > 0).all() or (column < 0).all():
            continue
        weights[bit] = np.log(shares[column > 0].mean(0)) - np.log(shares[column < 0].mean(0))
    model = Model(languages, codes, weights, np.zeros(codes.shape[1]), np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    # expected margin of each language under its own shares: places and scales every bit's threshold
    centres = shares @ weights.T
    ones, others = np.where(codes > 0, centres, np.inf).min(0), np.where(codes < 0, centres, -np.inf).max(0)
    finite = np.isfinite(ones) & np.isfinite(others)
    gap = np.where(finite, np.maximum(ones - others, 1e-3), 1.0)
    model.bias = np.where(finite, (np.where(finite, ones, 0) + np.where(finite, others, 0)) / 2, 0.0)
    model.scale = np.where(finite, 6 / gap, 0.0)
    model.trust = np.where(finite, gap / (gap + np.median(gap)), 0.0)
    return model


def _predict(handle):
    def run(batches):
        model: Model | None = handle.value
        for batch in batches:
            names, odds, clear = [], [], []
            marked = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False))
            for piece in pieces(batch, "doc_id", "text"):
                letters = marked[piece.first_row : piece.first_row + len(piece.ids)]
                if model is None:
                    best, sure = np.zeros(len(letters), int), np.zeros(len(letters))
                else:
                    best, sure, _ = model.decode(model.margins(piece))
                known = letters & (model is not None)
                names += [model.languages[b] if k else _UNKNOWN for b, k in zip(best, known, strict=True)]
                odds += np.where(known, sure, 0.0).tolist()
                clear += (known & (sure >= AMBIGUOUS)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(odds, pa.float64()), pa.array([not c for c in clear], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1), ambiguous.

    Learns from text and non-null language of ``train``; predicts from whole texts alone. A text that is null or has no
    letter gets ``und``, score 0, ambiguous; so does every text if ``train`` has no usable row. With one learned
    language every text with a letter is of it. Ties between codewords go to the language that sorts first. Repeated
    rows get equal results, null ids stay null, an empty table gives an empty one, other columns are not read.
    """
    spark = prepare(docs)
    model = fit(train, id_col, text_col, lang_col)
    handle = spark.sparkContext.broadcast(model)  # fixed size: FEATURES weights a bit
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small.mapInArrow(_predict(handle), "doc_id long, lang_pred string, score double, ambiguous boolean")


def _keep(handle, id_col: str, text_col: str):
    predict = _predict(handle)

    def run(batches):
        for batch in batches:
            small = pa.RecordBatch.from_arrays([batch.column(c) for c in (id_col, text_col)], ["doc_id", "text"])
            for marks in predict([small]):
                yield batch.filter(pc.invert(marks.column("ambiguous")))

    return run


def keep_identified(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is clear: texts marked ``und`` or ambiguous go. No shuffle.

    So null and empty texts and those without a letter go, and all rows if ``train`` has no usable one. Repeated rows
    share their fate, null ids do not matter, very long texts are read whole, an empty table gives an empty one.
    """
    spark = prepare(docs)
    handle = spark.sparkContext.broadcast(fit(train, id_col, text_col, lang_col))
    return docs.mapInArrow(_keep(handle, id_col, text_col), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Column: one document in five, by checksum of its id; never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
