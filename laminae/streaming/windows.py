"""Structured Streaming over event files: windows, sessions and first claims, run to the end of the available input.

Results are written by the stream to the shared folder and read back, so nothing passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from laminae.session import shared_folder


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of a table's files; ``path`` is a folder or a single file, so it is given as a pattern."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what is there: its last state (complete), all rows (append) or each key's last row (update)."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own files
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number:06d}")

    run = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    run.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    every = spark.read.schema(StructType([*stream.schema.fields]).add("batch", "string")).parquet(f"{folder}/out")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch", "left_semi").select(*stream.columns)


def windowed(spark: SparkSession, path: str, schema: StructType, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): events by tumbling or sliding window.

    A batch writes the windows it changed; the state of a window goes once the watermark, ``delay`` behind the latest
    event of the batches before, has passed it, and events that come later still are dropped.
    """
    rows, start = source(spark, path, schema), F.col("w.start")
    if schema["ts"].dataType == TimestampNTZType():  # read as UTC, since watermarks need instants
        own = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts")
        rows, start = rows.withColumn("ts", own.cast("timestamp")), F.convert_timezone(F.current_timezone(), F.lit("UTC"), start.cast("timestamp_ntz"))
    over = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = rows.withWatermark("ts", delay).groupBy(over.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(sums.select(start.alias("start"), "event_type", "n", "total"), "update", ["start", "event_type"])


def sessions(spark: SparkSession, path: str, schema: StructType, gap: str) -> DataFrame:
    """(user_id, start, end, n): sessions that end when a user pauses for ``gap``."""
    counts = source(spark, path, schema).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(counts.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), "complete")


def first_claims(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str) -> DataFrame:
    """The first ``order`` of each key: one state row a key, whatever the number of claims; a batch writes what it changed."""
    claims = source(spark, path, schema).groupBy(*keys).agg(F.min(order).alias(order))
    return drained(claims, "update", keys)
