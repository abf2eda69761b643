"""Session helpers of the operators: the shared folder, and states of iterative jobs that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a scratch folder where it is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_sums(df: DataFrame, order: list, columns: list[str]) -> tuple[DataFrame, dict]:
    """(``df`` with a running sum ``<c>_upto`` of each column, in ``order``; the columns' totals).

    Rows are range-partitioned by ``order`` and summed inside a range; a row a range gives what lies before it. So no
    task sees more than its range. ``order`` must be total.
    """
    part = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in part.groupBy("_part").agg(*(F.sum(c).alias(c) for c in columns)).collect())  # a row a range
    kinds = {f.name: f.dataType.simpleString() for f in part.groupBy().agg(*(F.sum(c).alias(c) for c in columns)).schema}
    rows, before = [], [0.0 if kinds[c] == "double" else 0 for c in columns]
    for number, *own in sums:
        rows.append((number, *before))
        before = [a + b for a, b in zip(before, own, strict=True)]
    starts = df.sparkSession.createDataFrame(rows, ", ".join(["_part int", *(f"_before_{c} {kinds[c]}" for c in columns)]))
    inside = Window.partitionBy("_part").orderBy(*order)
    out = part.join(F.broadcast(starts), "_part").select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(f"{c}_upto") for c in columns))
    return out, dict(zip(columns, before, strict=True))
