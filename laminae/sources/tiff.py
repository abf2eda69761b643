"""TIFF images and surfaces of three of them, by strips: a Python data source that deals strips to tasks.

Classic and big files of either byte order, one sample a pixel, plain, LZW or deflate, with horizontal or floating-point
prediction. What a file says is checked: strips that are missing, short or cannot be decoded are errors, never fill.
"""

from __future__ import annotations

import json
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from laminae.session import settled
from laminae.sources.files import names, read_at, replaced, size_of

#: Fixed values of the format: tags, field types by their struct code, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)
CLEAR, END = 256, 257
#: Strips that a partition reads.
PART_STRIPS = 256


class Image(NamedTuple):
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def describe(path: str) -> Image:
    """The first image of a file."""
    size = size_of(path)
    start = read_at(path, 0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8:
        raise ValueError(f"{path}: no TIFF file")
    magic = struct.unpack(f"{order}H", start[2:4])[0]
    if magic not in (42, 43) or magic == 43 and len(start) < 16:
        raise ValueError(f"{path}: no TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read_at(path, at, 8 if big else 2))[0]
    entry, wide = (20, 8) if big else (12, 4)
    if n * entry > size:
        raise ValueError(f"{path}: more tags than the file holds")
    raw = read_at(path, at + (8 if big else 2), n * entry)
    tags: dict[int, tuple] = {}
    for k in range(0, len(raw), entry):
        tag, kind = struct.unpack(f"{order}HH", raw[k : k + 4])
        count = struct.unpack(f"{order}{'Q' if big else 'I'}", raw[k + 4 : k + 4 + wide])[0]
        if kind not in FIELD:
            continue
        total, inline = struct.calcsize(FIELD[kind]) * count, raw[k + entry - wide : k + entry]
        if total > size:
            raise ValueError(f"{path}: tag {tag} is longer than the file")
        data = inline[:total] if total <= wide else read_at(path, struct.unpack(f"{order}{'Q' if big else 'I'}", inline)[0], total)
        tags[tag] = struct.unpack(f"{order}{count}{FIELD[kind]}", data)

    def one(tag: int, default: int | None = None) -> int:
        if tag not in tags and default is None:
            raise ValueError(f"{path}: tag {tag} is missing")
        return tags.get(tag, (default,))[0]

    width, height = one(WIDTH), one(HEIGHT)
    bits, sample = one(BITS, 1), one(FORMAT, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(sample)
    rows = min(one(ROWS, height), height)
    image = Image(width, height, f"{order}{kind}{bits // 8}", one(COMPRESSION, PLAIN), one(PREDICTOR, 1), rows, tags.get(OFFSETS, ()), tags.get(COUNTS, ()))
    known = bits in ((32, 64) if kind == "f" else (8, 16, 32)) and kind and image.compression in (PLAIN, LZW, *DEFLATE) and image.predictor in (1, 2, 3)
    if not known or one(SAMPLES, 1) != 1 or TILE in tags or width < 1 or height < 1 or rows < 1:
        raise ValueError(f"{path}: a kind of TIFF that is not read here")
    if not len(image.offsets) == len(image.counts) == -(-height // rows):
        raise ValueError(f"{path}: strips do not cover the image")
    return image


def unpack_lzw(data: bytes, size: int) -> bytes:
    """``size`` bytes from codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table: list[bytes] = []
    out, held, have, at, wide = bytearray(), 0, 0, 0, 9
    last = b""
    while len(out) < size:
        while have < wide:
            if at == len(data):
                raise ValueError("LZW data end too soon")
            held, have, at = (held << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        have -= wide
        code = held >> have & ((1 << wide) - 1)
        if code == CLEAR:
            table, wide, last = [], 9, b""
            continue
        if code == END:
            break
        if code < 256:
            word = bytes((code,))
        elif last and code - 258 < len(table):
            word = table[code - 258]
        elif last and code - 258 == len(table):
            word = last + last[:1]
        else:
            raise ValueError("LZW code that stands for nothing")
        out += word
        if last and len(table) < 4096 - 258:
            table.append(last + word[:1])
        last = word
        wide = min(12, max(9, (len(table) + 258 + 1).bit_length()))
    if len(out) != size:
        raise ValueError("LZW data of another size than the strip's")
    return bytes(out)


def _strip(path: str, image: Image, k: int) -> np.ndarray:
    rows = min(image.rows, image.height - k * image.rows)
    kind = np.dtype(image.dtype)
    size = rows * image.width * kind.itemsize
    raw = read_at(path, image.offsets[k], image.counts[k])
    if image.compression == LZW:
        raw = unpack_lzw(raw, size)
    elif image.compression in DEFLATE:
        raw = zlib.decompress(raw)
    if len(raw) != size:
        raise ValueError(f"{path}: strip {k} has {len(raw)} bytes, not {size}")
    if image.predictor == 3:  # byte planes, the highest first, as running differences along a row
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), 1, dtype=np.uint8).reshape(rows, kind.itemsize, image.width)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, image.width)
    pixels = np.frombuffer(raw, kind).reshape(rows, image.width)
    if image.predictor == 2:
        whole = pixels.view(kind.str[0] + f"u{kind.itemsize}")
        pixels = np.cumsum(whole, 1, dtype=f"u{kind.itemsize}").view(kind.newbyteorder("="))
    return pixels


class _Strips(InputPartition):
    def __init__(self, folder: str, image: str, low: int, high: int):
        super().__init__((folder, image, low, high))


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_strips: int):
        self.path, self.part_strips = path, part_strips

    def partitions(self):
        if self.path.endswith((".tif", ".tiff")):
            images = [("", self.path.rsplit("/", 1)[1])]
            self.root = self.path.rsplit("/", 1)[0]
        else:
            self.root = self.path
            folders = [n for n, folder in names(self.root) if folder] or [""]
            images = [(f, n) for f in folders for n, folder in names(f"{self.root}/{f}".rstrip("/")) if not folder and n.endswith((".tif", ".tiff"))]
        out = []
        for folder, name in images:
            strips = len(describe(f"{self.root}/{folder}/{name}").offsets)
            out += [_Strips(folder, name, low, min(low + self.part_strips, strips)) for low in range(0, strips, self.part_strips)]
        return out or [_Strips("", "", 0, 0)]

    def read(self, partition):
        folder, name, low, high = partition.value
        root = self.path.rsplit("/", 1)[0] if self.path.endswith((".tif", ".tiff")) else self.path
        path = f"{root}/{folder}/{name}"
        image = describe(path) if high > low else None
        for k in range(low, high):
            pixels = _strip(path, image, k)
            y, x = (a.reshape(-1) for a in np.indices(pixels.shape))
            n = len(y)
            columns = [pa.array([folder] * n), pa.array([name.rsplit(".", 1)[0]] * n), pa.array(y + k * image.rows), pa.array(x), pa.array(pixels.reshape(-1).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["folder", "image", "y", "x", "v"])


class TiffSource(DataSource):
    """``spark.read.format("tiffs").load(path)``: an image, a folder of them, or a folder of such folders."""

    @classmethod
    def name(cls):
        return "tiffs"

    def schema(self):
        return "folder string, image string, y long, x long, v double"

    def reader(self, schema):
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("partStrips", PART_STRIPS)))


def read(spark: SparkSession, path: str, part_strips: int = PART_STRIPS) -> DataFrame:
    """(folder, image, y, x, v) of all pixels."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiffs").option("partStrips", part_strips).load(path)


def _plan(path: str):
    """Work of tasks: a row (mesh, height, rows a band, what is wrong) for each folder, from its images' headers."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def work(batches):
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    images = [describe(f"{path}/{folder}/{a}.tif") for a in "zyx"]
                except FileNotFoundError as missing:
                    rows.append((folder, 0, 1, f"surface {folder or path} lacks an image: {missing}"))
                    continue
                apart = len({i[:2] for i in images}) > 1
                rows.append((folder, images[0].height, max(i.rows for i in images) * PART_STRIPS, f"surface {folder or path}: images of different sizes" if apart else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["mesh", "height", "band", "wrong"])

    return work


def _band(path: str, low: int, high: int) -> np.ndarray:
    """Rows of an image from the strips that hold them."""
    image = describe(path)
    first = low // image.rows
    strips = [_strip(path, image, k) for k in range(first, -(-high // image.rows))]
    return np.concatenate(strips)[low - first * image.rows : high - first * image.rows].astype(np.float64)


def read_surfaces(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """(mesh, u, v, z, y, x, valid): surfaces of images x, y and z, one in ``path`` or one in each folder of it.

    A cell with a negative coordinate or none is not valid; ``scale`` lifts valid cells to another level. Surfaces that lack
    an image, or whose images differ in size, are errors, found from the headers before anything is read. Tasks read
    headers and bands of rows of many surfaces, so the driver sees only the folders' names.
    """
    folders = [(n,) for n, folder in names(path) if folder] or [("",)]
    plan = settled(spark.createDataFrame(folders, "mesh string").mapInArrow(_plan(path), "mesh string, height long, band long, wrong string"))
    for row in plan.filter("wrong is not null").limit(1).collect():
        raise ValueError(row.wrong)
    bands = plan.select("mesh", "height", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, F.col("band"))).alias("low"))
    tasks = min(bands.count(), max(4 * spark.sparkContext.defaultParallelism, len(folders) // 128))

    def cells(batches):
        for batch in batches:
            for row in batch.to_pylist():
                low, high = row["low"], min(row["low"] + row["band"], row["height"])
                found = [_band(f"{path}/{row['mesh']}/{a}.tif", low, high) for a in "zyx"]
                v, u = (a.reshape(-1) for a in np.indices(found[0].shape))
                flat = [f.reshape(-1) for f in found]
                with np.errstate(invalid="ignore"):
                    valid = np.logical_and.reduce([f >= 0 for f in flat])
                flat = [np.where(valid, f * scale, f) for f in flat]
                yield pa.RecordBatch.from_arrays([pa.array([row["mesh"]] * len(u), pa.string()), pa.array(u), pa.array(v + low), *map(pa.array, flat), pa.array(valid)], ["mesh", "u", "v", "z", "y", "x", "valid"])

    return bands.repartition(tasks).mapInArrow(cells, "mesh string, u long, v long, z double, y double, x double, valid boolean")


def surface_scale(path: str) -> tuple[float, float]:
    """Grid cells a voxel along u and v, from a surface's meta.json; (1, 1) if there is no such file."""
    try:
        size = size_of(f"{path}/meta.json")
    except FileNotFoundError:
        return 1.0, 1.0
    scale = json.loads(read_at(f"{path}/meta.json", 0, size)).get("scale", [1.0, 1.0])
    return float(scale[0]), float(scale[1])


def encode(image: np.ndarray, rows: int = 64) -> bytes:
    """A plain little-endian classic TIFF of 32-bit floats, by strips of ``rows`` rows."""
    image = np.ascontiguousarray(image, "<f4")
    height, width = image.shape
    strips = [image[k : k + rows].tobytes() for k in range(0, height, rows)]
    n = len(strips)
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32]), (COMPRESSION, 3, [PLAIN]), (262, 3, [1]), (OFFSETS, 4, None), (SAMPLES, 3, [1]), (ROWS, 4, [rows]), (COUNTS, 4, [len(s) for s in strips]), (FORMAT, 3, [3])]
    lists = 8 + 2 + 12 * len(tags) + 4
    first = lists + 8 * n
    starts = [first + sum(len(s) for s in strips[:1]) * k for k in range(n)]
    out = b"II" + struct.pack("<HIH", 42, 8, len(tags))
    for tag, kind, values in tags:
        values = starts if tag == OFFSETS else values
        data = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        place = lists if tag == OFFSETS else lists + 4 * n
        out += struct.pack("<HHI", tag, kind, len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place))
    return out + struct.pack("<I", 0) + struct.pack(f"<{n}I", *starts) + struct.pack(f"<{n}I", *(len(s) for s in strips)) + b"".join(strips)


def write_surfaces(cells: DataFrame, path: str, scale: tuple[float, float] = (1.0, 1.0)) -> int:
    """Writes surfaces (mesh, u, v, z, y, x), each in a folder of its own by a task of its own; returns their number.

    The grid runs from u = v = 0 to the largest of each; cells that are not there become -1. A surface must fit a task.
    """

    def put(group: pd.DataFrame) -> pd.DataFrame:
        mesh = str(group["mesh"].iloc[0])
        u, v = group["u"].to_numpy(), group["v"].to_numpy()
        for a in "xyz":
            image = np.full((int(v.max()) + 1, int(u.max()) + 1), -1.0)
            image[v, u] = group[a].to_numpy()
            with replaced(f"{path}/{mesh}/{a}.tif") as out:
                out.write(encode(image))
        with replaced(f"{path}/{mesh}/meta.json") as out:
            out.write(json.dumps({"format": "tifxyz", "scale": list(scale)}).encode())
        return pd.DataFrame({"mesh": [mesh]})

    rows = cells.select(F.col("mesh").cast("string").alias("mesh"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *(F.col(a).cast("double").alias(a) for a in "zyx"))
    return rows.groupBy("mesh").applyInPandas(put, "mesh string").count()
