"""Corpus pipeline: the training-data operators in a row, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laminae.llm import stages
from laminae.llm.common import stored

#: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("ngram_jaccard", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("best_fit_packing", stages.packing),
]
#: Hash windows and best-fit rounds are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
