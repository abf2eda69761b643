"""Pipeline stages: (spark, docs, sf_dir) -> documents kept, with the columns of ``documents``; packing ends the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import langid as _langid
from . import ngram_join as _near
from . import packing as _packing
from . import substring_dedup as _substrings
from .common import stored

CAPACITY = 1024
END_ID = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; others are rejected."""
    return _langid.keep_identified(docs, docs.filter(~_langid.held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    marks = stored(_exact.exact_duplicates(docs), "exact")
    if not marks.filter("not kept and doc_id <=> keep_id").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    dropped = marks.filter("not kept and not doc_id <=> keep_id").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_id"]) & (sha == dropped["_sha"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more), that with the least doc_id."""
    marks = _near.near_duplicates(docs, width=5, percent=80)
    dropped = marks.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a document of which nothing is left goes."""
    return _substrings.cut_documents(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return _packing.pack(docs, CAPACITY, END_ID)
