"""Dense arrays in npy files, one or a folder of slabs, as voxel rows: a Python data source that deals out slices."""

from __future__ import annotations

import ast
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from laminae.sources.files import is_folder, names, read_at, replaced, size_of

KEY = ["z", "y", "x"]
#: Bytes of slices that a partition reads, about.
PART_BYTES = 64 << 20
#: Voxels of a batch handed to Spark.
BATCH = 1 << 18


def header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """(dtype, shape, first byte of the data); other than C order, three axes and the size it says are errors."""
    start = read_at(path, 0, 12)
    if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2):
        raise ValueError(f"{path}: no npy file")
    size, at = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
    about = ast.literal_eval(read_at(path, at, size).decode("latin1"))
    kind, shape = np.dtype(about["descr"]), tuple(about["shape"])
    if about["fortran_order"] or len(shape) != 3 or kind.kind not in "biuf":
        raise ValueError(f"{path}: not a C-ordered array of numbers with three axes")
    if size_of(path) != at + size + kind.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{path}: size differs from what its header says")
    return kind, shape, at + size


class _Slices(InputPartition):
    def __init__(self, path: str, low: int, high: int, first: int):
        super().__init__((path, low, high, first))


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self):
        files = [(self.path, 0)]
        if is_folder(self.path):
            found = [(n, re.fullmatch(r"slab-(\d+)\.npy", n)) for n, folder in names(self.path) if not folder]
            files = [(f"{self.path}/{n}", int(m[1])) for n, m in found if m]
        out = []
        for path, first in files:
            kind, shape, _ = header(path)
            step = max(1, self.part_bytes // max(1, kind.itemsize * shape[1] * shape[2]))
            out += [_Slices(path, low, min(low + step, shape[0]), first) for low in range(0, shape[0], step)]
        return out or [_Slices("", 0, 0, 0)]

    def read(self, partition):
        path, low, high, first = partition.value
        if high == low:
            return
        kind, shape, start = header(path)
        plane = shape[1] * shape[2]
        data = np.frombuffer(read_at(path, start + kind.itemsize * plane * low, kind.itemsize * plane * (high - low)), kind)
        for at in range(0, len(data), BATCH):
            index = np.arange(at, min(at + BATCH, len(data)))
            columns = [index // plane + low + first, index // shape[2] % shape[1], index % shape[2], data[index].astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, "v"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``; option ``partBytes``."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "z long, y long, x long, v double"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def read(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(z, y, x, v) of every voxel of an npy file, or of the slabs that ``write`` put into a folder."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partBytes", part_bytes).load(path)


def write(vox: DataFrame, folder: str, shape: tuple[int, int, int], dtype: str = "<f4", depth: int = 64) -> int:
    """Writes (z, y, x, v) as slabs of ``depth`` slices, a task and a file each, named by their first slice; returns their number.

    Absent voxels are 0; integers are rounded and clamped. Slabs without voxels are written too.
    """
    kind = np.dtype(dtype)
    spark, slabs = vox.sparkSession, -(-shape[0] // depth)
    dealt = vox.select(*(F.col(a).cast("long").alias(a) for a in KEY), F.col("v").cast("double").alias("v")).withColumn("slab", F.floor(F.col("z") / depth))
    none = [F.lit(None).cast("long").alias(a) for a in KEY]
    dealt = dealt.union(spark.range(slabs).select(*none, F.lit(None).cast("double").alias("v"), F.col("id").alias("slab")))

    def put(group: pd.DataFrame) -> pd.DataFrame:
        first = int(group["slab"].iloc[0]) * depth
        real = group[group["v"].notna()]
        block = np.zeros((min(depth, shape[0] - first), *shape[1:]))
        block[tuple(real[a].to_numpy().astype(np.int64) - (first if a == "z" else 0) for a in KEY)] = real["v"].to_numpy()
        if kind.kind in "iu":
            ends = np.iinfo(kind)
            block = np.clip(np.rint(block), ends.min, ends.max)
        with replaced(f"{folder}/slab-{first:010d}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(block.astype(kind)), version=(1, 0), allow_pickle=False)
        return pd.DataFrame({"first": [first]})

    return dealt.groupBy("slab").applyInPandas(put, "first long").count()


def to_bytes(vox: DataFrame) -> DataFrame:
    """Probabilities from 0 to 1 as 0 to 255."""
    return vox.withColumn("v", F.greatest(F.least(F.rint(F.col("v") * 255), F.lit(255.0)), F.lit(0.0)))
