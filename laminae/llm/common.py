"""Session helpers that the training-data operators share."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminae.session import running_sums

#: Rows of a batch handed to Python at most, so that a batch of long texts still fits a worker.
ARROW_ROWS = "2000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a scratch one if it is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def prepare(df: DataFrame) -> SparkSession:
    """Settings that every operator here relies on: a shared folder and small Arrow batches."""
    spark = df.sparkSession
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_seed() -> int:
    """Of hashes that only route rows: results do not depend on it, and no text can be written to collide under it."""
    return secrets.randbits(64)


def total_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, from one narrow scan; sizes the exchanges."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that number the rows of one repeated id.
TURN_SHARES = 64


def keyed(docs: DataFrame, id_col: str, key: str) -> tuple[DataFrame, int, DataFrame | None]:
    """(``docs`` with column ``key``, its number of low bits, names): a number of its own for every row with an id.

    Keys are in the order of ids, and rows that share an id differ in the low bits alone. Where ids leave no room for
    these, what stands above them is the id's rank, and names (rank, id) tell whose. Null ids have a null key. Only rows
    of repeated ids are numbered, each id's in TURN_SHARES tasks.
    """
    number = F.col(id_col).cast("long")
    k, turn, share = (f"{key}_{x}" for x in ("k", "turn", "share"))
    again = stored(docs.groupBy(number.alias(k)).agg(F.count("*").alias("n")).filter(f"n > 1 and {k} is not null").select(k), "repeated")
    if again.isEmpty():
        return docs.withColumn(key, number), 0, None
    some = docs.filter(number.isNotNull())
    once = some.join(again, number == again[k], "left_anti").withColumn(turn, F.lit(0).cast("long"))
    many = some.join(again, number == again[k], "left_semi").withColumn(share, F.pmod(F.monotonically_increasing_id(), F.lit(TURN_SHARES)))
    own = Window.partitionBy(number, share).orderBy(share)
    many = many.withColumn(turn, (F.row_number().over(own) - 1) * TURN_SHARES + F.col(share)).drop(share)
    rows = stored(once.union(many), "keyed")
    low, high, most = rows.agg(F.min(number), F.max(number), F.max(turn)).first()
    bits, names = most.bit_length(), None
    room = 1 << (63 - bits)
    if -room <= low and high < room:
        rows = rows.withColumn(key, F.shiftleft(number, bits) + F.col(turn))
    else:
        ids = rows.select(number.alias("id")).distinct().withColumn("rank", F.lit(1).cast("long"))
        ranked, total = running_sums(ids, ["id"], ["rank"])
        if total["rank"] >= room:
            raise ValueError("too many ids and too many rows of one id for a key of 64 bits")
        names = stored(ranked.select(F.col("rank_upto").alias("rank"), "id"), "names")
        rank = names.select(F.col("rank").alias(k), F.col("id").alias(share))
        rows = rows.join(rank, number == rank[share]).withColumn(key, F.shiftleft(k, bits) + F.col(turn))
    nameless = docs.filter(number.isNull()).withColumn(key, F.lit(None).cast("long"))
    return rows.select(*docs.columns, key).union(nameless), bits, names
