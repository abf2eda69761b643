"""Queries over the given tables: each numbered operator with production parameters, and the digests they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, mlm, neighbours, ngram_join, packing, periodic, quality, resampling, substring_dedup, token_files, webp
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.filter(~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(read_table(spark, sf_dir, "documents"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = webp.from_media(webp.to_media(read_table(spark, sf_dir, "documents")))
    payload = F.octet_length("samples").cast("long")
    tail = F.crc32(F.substring("samples", -32, 32))
    return out.select("doc_id", "n_bytes", payload.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mlm.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality.score(docs, labels, host="source", path="concat_ws('/', source, lang)")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), k=20, query="vec_id % 20 = 0")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where every tenth document, by a hash of its id, repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("own")
    from_word = F.col("g") % F.col("n")
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("own", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int"))), " ")
    told = docs.select("doc_id", "text", h.alias("h")).withColumn("own", F.when(F.col("h") % 10 == 0, words)).withColumn("g", g).withColumn("n", n.cast("long"))
    told = told.withColumn("a", F.when(F.col("n") > 0, from_word)).withColumn("p", F.when(F.col("n") > 0, period))
    return told.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(planted(read_table(spark, sf_dir, "documents")))
    collapsed = F.coalesce(F.sha2(F.col("collapsed").cast("binary"), 256), F.col("plain_sha256"))
    listing = F.sha2(F.coalesce("listing", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", listing.alias("runs_sha256"), collapsed.alias("collapsed_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resampling.resample(docs, target, percent=10, longest=1, buckets=10000, least_words=20, seed="2024")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_webp_media": op6_webp_media,
    "op7_masked_lm": op7_masked_lm,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}

#: DuckDB SQL where SQL has the functions; the other queries are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) h FROM documents),
        g AS (SELECT h, max(doc_id) keep_id, count(*) group_size FROM d GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
}
