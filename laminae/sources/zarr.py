"""Chunked arrays (zarr, versions 2 and 3, sharded or not) as sparse volumes, read by Spark's own file readers.

Metadata and chunks come through ``spark.read``, so any store that Spark can open works. A chunk file that is missing
is fill; one that cannot be decoded or has the wrong size is an error, never fill.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("z", "y", "x")


def _small_file(spark: SparkSession, path: str) -> str:
    """A metadata file's text; Spark's readers pass over names that begin with a dot, its file systems do not."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Fixed values of version 3: data types by name, and an inner chunk's place in a shard's index if it is absent.
DTYPES = {"bool": "|b1", **{f"{'u' if k == 'u' else ''}int{n}": f"<{k}{n // 8}" for k in "iu" for n in (8, 16, 32, 64)}, "float32": "<f4", "float64": "<f8"}
ABSENT = (1 << 64) - 1
COMPRESSORS = (None, "zlib", "gzip")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _codecs(codecs: list[dict]) -> tuple[str, str | None]:
    """(byte order, compressor) of a chain of bytes and at most one compressor."""
    order, kind = "<", None
    for codec in codecs:
        if codec["name"] == "bytes":
            order = ">" if codec.get("configuration", {}).get("endian") == "big" else "<"
        elif codec["name"] in COMPRESSORS and kind is None:
            kind = codec["name"]
        elif codec["name"] != "crc32c":
            raise ValueError(f"unknown codec {codec['name']}")
    return order, kind


def metadata(spark: SparkSession, root: str) -> dict:
    """Shape, chunk shape, dtype, fill, key layout, compressor and, of a sharded array, the inner chunks."""
    if _exists(spark, f"{root}/zarr.json"):
        return _metadata3(json.loads(_small_file(spark, f"{root}/zarr.json")))
    meta = json.loads(_small_file(spark, f"{root}/.zarray"))
    if meta.get("zarr_format") != 2 or len(meta["shape"]) != 3:
        raise ValueError("not a three-dimensional zarr version 2 array")
    kind = (meta.get("compressor") or {}).get("id")
    if kind not in COMPRESSORS:
        raise ValueError(f"unknown compressor {kind}")
    return {"shape": meta["shape"], "chunks": meta["chunks"], "dtype": meta["dtype"], "fill": meta.get("fill_value") or 0, "separator": meta.get("dimension_separator", "."), "prefix": "", "compressor": kind, "inner": None, "checked": False}


def _metadata3(meta: dict) -> dict:
    if meta.get("zarr_format") != 3 or meta.get("node_type") != "array" or len(meta["shape"]) != 3:
        raise ValueError("not a three-dimensional zarr version 3 array")
    keys = meta.get("chunk_key_encoding", {"name": "default"})
    plain = keys["name"] == "default"
    separator = keys.get("configuration", {}).get("separator", "/" if plain else ".")
    codecs, inner, start, checked = meta["codecs"], None, False, False
    if codecs[0]["name"] == "sharding_indexed":
        shard = codecs[0]["configuration"]
        codecs, inner, start = shard["codecs"], shard["chunk_shape"], shard.get("index_location", "end") == "start"
        checked = any(c["name"] == "crc32c" for c in shard.get("index_codecs", []))
    order, kind = _codecs(codecs)
    tail = 4 if any(c["name"] == "crc32c" for c in codecs) else 0
    dtype = DTYPES[meta["data_type"]].replace("<", order)
    return {"shape": meta["shape"], "chunks": meta["chunk_grid"]["configuration"]["chunk_shape"], "dtype": dtype, "fill": meta.get("fill_value") or 0, "separator": separator, "prefix": f"c{separator}" if plain else "", "compressor": kind, "inner": inner, "index_first": start, "checked": checked, "tail": tail}


def _block(raw: bytes, meta: dict, shape: list[int], name: str) -> np.ndarray:
    raw = raw[: len(raw) - meta.get("tail", 0)]
    if meta["compressor"]:
        raw = zlib.decompress(raw, 47)
    dtype = np.dtype(meta["dtype"])
    if len(raw) != dtype.itemsize * math.prod(shape):
        raise ValueError(f"chunk {name} has {len(raw)} bytes")
    return np.frombuffer(raw, dtype).reshape(shape)


def _blocks(raw: bytes, meta: dict, key: list[int]):
    """(corner inside the chunk, block) of the chunk file, or of every inner chunk that a shard holds."""
    name = ", ".join(map(str, key))
    if not meta["inner"]:
        yield [0, 0, 0], _block(raw, meta, meta["chunks"], name)
        return
    counts = [c // n for c, n in zip(meta["chunks"], meta["inner"], strict=True)]
    size = 16 * math.prod(counts)
    if len(raw) < size + 4 * meta["checked"]:
        raise ValueError(f"shard {name} is shorter than its index")
    at = 0 if meta["index_first"] else len(raw) - size - 4 * meta["checked"]
    index = np.frombuffer(raw, "<u8", 2 * math.prod(counts), at).reshape(-1, 2).tolist()
    for k, (start, length) in enumerate(index):
        if start == length == ABSENT:
            continue
        if start + length > len(raw):
            raise ValueError(f"shard {name} ends inside chunk {k}")
        corner = [i * n for i, n in zip(np.unravel_index(k, counts), meta["inner"], strict=True)]
        yield [int(c) for c in corner], _block(raw[start : start + length], meta, meta["inner"], f"{name} / {k}")


def _decode(meta: dict, low: list[int], high: list[int]):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                row = batch.slice(k, 1).to_pylist()[0]
                key = [row[f"c{a}"] for a in KEY]
                for corner, block in _blocks(row["content"], meta, key):
                    corner = [c * n + i for c, n, i in zip(key, meta["chunks"], corner, strict=True)]
                    lo = [max(b, c) for b, c in zip(low, corner, strict=True)]
                    hi = [min(h, c + n, s) for h, c, n, s in zip(high, corner, block.shape, meta["shape"], strict=True)]
                    if any(h <= b for b, h in zip(lo, hi, strict=True)):
                        continue
                    part = block[tuple(slice(b - c, h - c) for b, h, c in zip(lo, hi, corner, strict=True))]
                    at = np.indices(part.shape).reshape(3, -1) + np.array(lo)[:, None]
                    yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in at), pa.array(part.reshape(-1).astype(np.float64))], [*KEY, "v"])

    return run


def _pattern(meta: dict, low: list[int], high: list[int]) -> str:
    """A path pattern of the chunk files that meet the box, so that others are not even listed."""
    parts = []
    for lo, hi, n in zip(low, high, meta["chunks"], strict=True):
        numbers = range(lo // n, -(-hi // n))
        parts.append("{" + ",".join(map(str, numbers)) + "}" if len(numbers) <= 1000 else "*")
    return meta["prefix"] + meta["separator"].join(parts)


def read_box(spark: SparkSession, root: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """(z, y, x, v) of the stored voxels in the half-open box; voxels of missing chunks have no row.

    Only files of chunks that meet the box are listed and decoded, one at a time; a shard's absent chunks are fill too.
    """
    meta = metadata(spark, root)
    low, high = list(low or (0, 0, 0)), [min(h, n) for h, n in zip(high or meta["shape"], meta["shape"], strict=True)]
    schema = "z long, y long, x long, v double"
    mark = "/" if meta["separator"] == "/" else "\\."
    pattern = f"(\\d+){mark}(\\d+){mark}(\\d+)$"
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{_pattern(meta, low, high)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    keyed = files.filter(F.col("path").rlike(pattern)).select(*(F.regexp_extract("path", pattern, k + 1).cast("long").alias(f"c{a}") for k, a in enumerate(KEY)), "content")
    for a, lo, hi, n in zip(KEY, low, high, meta["chunks"], strict=True):
        keyed = keyed.filter((F.col(f"c{a}") >= lo // n) & (F.col(f"c{a}") * n < hi))
    return keyed.mapInArrow(_decode(meta, low, high), schema)


def filled(vox: DataFrame, shape: tuple[int, int, int], fill: float) -> DataFrame:
    """The dense volume: voxels without a row get ``fill``."""
    n = shape[0] * shape[1] * shape[2]
    grid = vox.sparkSession.range(n).select(F.floor(F.col("id") / (shape[1] * shape[2])).alias("z"), (F.floor(F.col("id") / shape[2]) % shape[1]).alias("y"), (F.col("id") % shape[2]).alias("x"))
    return grid.join(vox, list(KEY), "left").select(*KEY, F.coalesce("v", F.lit(float(fill))).alias("v"))
