"""Volumes as tables of compressed chunks beside a ledger: written in Morton order, committed after the data, resumable.

A chunk is a row (cz, cy, cx, code, n, body): zlib-compressed values of its dense block and a bit for each voxel that is
present. The ledger has a row for every committed chunk, REAL or ZERO (present, all zero); chunks without one are absent.
Data files that no ledger row names, of a write that was lost before its commit, are never read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminae.functions.numeric import morton
from laminae.operators.bands import reached
from laminae.session import settled

KEY = ("z", "y", "x")
CHUNK = [f"c{a}" for a in KEY]
_ROWS = "cz long, cy long, cx long, state string, n long, body binary"
#: Chunks that one file holds, about.
CHUNKS_A_FILE = 4096


def _encode(side: int, dtype: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = [int(group[c].iloc[0]) for c in CHUNK]
        block, there = np.zeros((side,) * 3, dtype), np.zeros((side,) * 3, bool)
        at = tuple(group[a].to_numpy() - k * side for a, k in zip(KEY, key))
        block[at], there[at] = group["v"].to_numpy(), True
        body = zlib.compress(np.packbits(there).tobytes() + block.tobytes(), 6)
        return pd.DataFrame([[*key, "REAL" if block.any() else "ZERO", int(there.sum()), body]], columns=[*CHUNK, "state", "n", "body"])

    return run


def _chunk_of(side: int) -> list:
    return [F.floor(F.col(a) / side).alias(c) for a, c in zip(KEY, CHUNK, strict=True)]


def describe(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first()[0])


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(cz, cy, cx, state, n, part): the last commit of every chunk."""
    rows = spark.read.schema("cz long, cy long, cx long, state string, n long, part string, turn long").parquet(f"{path}/ledger")
    return rows.groupBy(*CHUNK).agg(F.max_by(F.struct("state", "n", "part"), "turn").alias("_r")).select(*CHUNK, "_r.*")


def write(vox: DataFrame, path: str, side: int = 64, dtype: str = "<u1") -> None:
    """Adds (z, y, x, v) to the archive at ``path`` chunk by chunk; a chunk that is there already is replaced whole.

    Chunks are dealt to files by ranges of their Morton code, so neighbours share files. The ledger is appended to last.
    """
    spark = vox.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    fresh = not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    about = {"side": side, "dtype": dtype}
    if fresh:
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    elif describe(spark, path) != about:
        raise ValueError("the archive has another chunk side or type")
    part, turn = uuid.uuid4().hex, 0 if fresh else (spark.read.parquet(f"{path}/ledger").agg(F.max("turn")).first()[0] or 0) + 1
    encoded = vox.select(*KEY, "v", *_chunk_of(side)).groupBy(*CHUNK).applyInPandas(_encode(side, dtype), _ROWS)
    ordered = encoded.withColumn("code", morton(F.col("cz"), F.col("cy"), F.col("cx"), 20))
    files = max(1, vox.select(*_chunk_of(side)).distinct().count() // CHUNKS_A_FILE)
    ordered.repartitionByRange(files, "code").sortWithinPartitions("code").write.option("compression", "none").parquet(f"{path}/data/{part}")
    done = spark.read.parquet(f"{path}/data/{part}").select(*CHUNK, "state", "n", F.lit(part).alias("part"), F.lit(turn).cast("long").alias("turn"))
    done.write.mode("append").parquet(f"{path}/ledger")


def pending(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Chunks (cz, cy, cx) that are not committed yet: where an export goes on after it was stopped."""
    return wanted.select(*CHUNK).distinct().join(ledger(spark, path).select(*CHUNK), CHUNK, "left_anti")


def _decode(side: int, dtype: str):
    bits = -(-(side**3) // 8)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one chunk at a time
                row = batch.slice(k, 1).to_pylist()[0]
                raw = zlib.decompress(row["body"])
                there = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=side**3).astype(bool)
                values = np.frombuffer(raw, dtype, side**3, bits)[there].astype(np.float64)
                at = np.stack(np.unravel_index(np.flatnonzero(there), (side,) * 3))
                yield pa.RecordBatch.from_arrays([*(pa.array(a + row[c] * side) for a, c in zip(at, CHUNK, strict=True)), pa.array(values)], [*KEY, "v"])

    return run


def read(spark: SparkSession, path: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """(z, y, x, v) of the present voxels in the half-open box; only its chunks are read and decoded.

    Morton order keeps a box in few files, whose statistics of cz, cy and cx let Spark pass over the others.
    """
    about = describe(spark, path)
    side = about["side"]
    data = spark.read.option("recursiveFileLookup", "true").schema(f"{_ROWS}, code long").parquet(f"{path}/data").withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    known = ledger(spark, path).select(*CHUNK, "part")
    inside = F.lit(True)
    for a, c, lo, hi in zip(KEY, CHUNK, low or (None,) * 3, high or (None,) * 3, strict=True):
        if lo is not None:
            data, known, inside = data.filter(F.col(c) >= lo // side), known.filter(F.col(c) >= lo // side), inside & (F.col(a) >= lo)
        if hi is not None:
            data, known, inside = data.filter(F.col(c) * side < hi), known.filter(F.col(c) * side < hi), inside & (F.col(a) < hi)
    rows = data.join(known, [*CHUNK, "part"], "left_semi").select(*CHUNK, "body")
    return rows.mapInArrow(_decode(side, about["dtype"]), "z long, y long, x long, v double").filter(inside)


#: Ranges of Morton codes that a scan is told to keep to, at most.
CODE_RANGES = 64


def read_chunks(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """(z, y, x, v) of the present voxels of chunks (cz, cy, cx); no others are decoded, and files without any are passed over.

    The chunks' codes, gathered into CODE_RANGES ranges, are pushed to the scan, whose file statistics are ranges of codes.
    """
    about = describe(spark, path)
    code = morton(F.col("cz"), F.col("cy"), F.col("cx"), 20)
    asked = settled(chunks.select(*CHUNK).distinct().withColumn("code", code))
    low, high = asked.agg(F.min("code"), F.max("code")).first()
    if low is None:
        return spark.createDataFrame([], "z long, y long, x long, v double")
    width = (high - low) // CODE_RANGES + 1
    ranges = asked.groupBy(F.floor((F.col("code") - low) / width)).agg(F.min("code").alias("a"), F.max("code").alias("b")).collect()  # CODE_RANGES rows at most
    within = F.lit(False)
    for r in ranges:
        within = within | F.col("code").between(r["a"], r["b"])
    data = spark.read.option("recursiveFileLookup", "true").schema(f"{_ROWS}, code long").parquet(f"{path}/data").filter(within)
    data = data.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    known = ledger(spark, path).select(*CHUNK, "part").join(asked.select(*CHUNK), CHUNK, "left_semi")
    rows = data.join(known, [*CHUNK, "part"], "left_semi").select(*CHUNK, "body")
    return rows.mapInArrow(_decode(about["side"], about["dtype"]), "z long, y long, x long, v double")


def read_band(spark: SparkSession, path: str, cells: DataFrame, reach: float) -> DataFrame:
    """(z, y, x, v) of chunks that come within ``reach`` of a surface cell (z, y, x), whole."""
    return read_chunks(spark, path, reached(cells, describe(spark, path)["side"], reach, CHUNK))


def gather(points: DataFrame, spark: SparkSession, path: str, shape: tuple[int, int, int]) -> DataFrame:
    """(id, value) of points (id, z, y, x), clamped into ``shape``; absent voxels are 0. Only chunks that are asked for are decoded."""
    about = describe(spark, path)
    at = points.select("id", *(F.least(F.greatest(F.floor(a), F.lit(0)), F.lit(n - 1)).alias(a) for a, n in zip(KEY, shape, strict=True)))
    asked = at.select(*_chunk_of(about["side"])).distinct()
    data = spark.read.option("recursiveFileLookup", "true").schema(f"{_ROWS}, code long").parquet(f"{path}/data").withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    rows = data.join(ledger(spark, path).select(*CHUNK, "part").join(asked, CHUNK, "left_semi"), [*CHUNK, "part"], "left_semi")
    vox = rows.select(*CHUNK, "body").mapInArrow(_decode(about["side"], about["dtype"]), "z long, y long, x long, v double")
    return at.join(vox, list(KEY), "left").select("id", F.coalesce("v", F.lit(0.0)).alias("value"))


def transcode(spark: SparkSession, source: str, target: str, side: int, dtype: str) -> None:
    """Copies an archive into chunks of another side or values of another type; chunks that are there are not redone."""
    vox = read(spark, source)
    exists = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/about")
    if exists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(exists):
        left = pending(vox.select(*_chunk_of(side)), spark, target)
        vox = vox.select("*", *_chunk_of(side)).join(left, CHUNK, "left_semi").select(*KEY, "v")
    if not vox.isEmpty():
        write(vox, target, side, dtype)
