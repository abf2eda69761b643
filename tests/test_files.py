"""npy and TIFF sources: round trips, every coding, and files that are not what they say."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminae.sources import npy, tiff


def voxels(df, shape):
    out, p = np.full(shape, np.nan), df.toPandas()
    assert len(p) == np.prod(shape)
    out[p.z, p.y, p.x] = p.v
    return out


@pytest.mark.parametrize("kind", ["|u1", "<f4", ">i2"])
def test_npy_by_slices(spark, tmp_path, kind):
    block = np.random.default_rng(1).integers(0, 200, (7, 5, 6)).astype(kind)
    np.save(tmp_path / "a.npy", block)
    df = npy.read(spark, f"{tmp_path}/a.npy", part_bytes=100)
    assert df.rdd.getNumPartitions() > 1 and (voxels(df, block.shape) == block).all()


def test_npy_written_by_slabs(spark, tmp_path):
    rows = [(0, 0, 0, 3.4), (4, 1, 2, 300.0), (4, 0, 0, -2.0)]
    vox = spark.createDataFrame(rows, "z int, y int, x int, v double")
    assert npy.write(vox, f"{tmp_path}/out", (7, 2, 3), "|u1", depth=3) == 3
    want = np.zeros((7, 2, 3))
    want[0, 0, 0], want[4, 1, 2] = 3, 255
    assert (voxels(npy.read(spark, f"{tmp_path}/out"), want.shape) == want).all()
    assert (np.load(tmp_path / "out" / "slab-0000000003.npy")[1, 1, 2]) == 255
    assert [r.v for r in npy.to_bytes(vox.limit(1)).collect()] == [255.0]


def test_npy_that_is_not_what_it_says(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((3, 4, 5), "<f4"))
    whole = (tmp_path / "a.npy").read_bytes()
    for name, data in (("short", whole[:-1]), ("long", whole + b"x"), ("magic", b"x" + whole[1:]), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            npy.header(f"{tmp_path}/{name}")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((3, 4, 5))))
    np.save(tmp_path / "d.npy", np.zeros((3, 4)))
    for name in ("f.npy", "d.npy"):
        with pytest.raises(ValueError):
            npy.header(f"{tmp_path}/{name}")
    with pytest.raises(FileNotFoundError):
        npy.header(f"{tmp_path}/none.npy")


def packed_lzw(data):
    """Codes of a TIFF LZW stream, the table full and cleared when need be."""
    out, have, bits = bytearray(), 0, 0

    def put(code, wide):
        nonlocal have, bits
        bits = bits << wide | code
        have += wide
        while have >= 8:
            out.append(bits >> (have - 8) & 255)
            have -= 8
        bits &= (1 << have) - 1

    table, wide, word = {bytes((k,)): k for k in range(256)}, 9, b""
    put(256, wide)
    fresh = 258
    for k in data:
        longer = word + bytes((k,))
        if longer in table:
            word = longer
            continue
        put(table[word], wide)
        table[longer] = fresh
        fresh += 1
        wide = max(9, fresh.bit_length()) if fresh < 4095 else 12
        word = bytes((k,))
        if fresh == 4094:
            put(table[word], wide)
            put(256, wide)
            table, wide, fresh, word = {bytes((k,)): k for k in range(256)}, 9, 258, b""
    if word:
        put(table[word], wide)
        fresh += 1
        wide = max(9, fresh.bit_length())
    put(257, wide)
    put(0, 7)
    return bytes(out)


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
@pytest.mark.parametrize("letters", [2, 256])
def test_lzw(n, letters):
    data = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(packed_lzw(data), n) == data
    with pytest.raises(ValueError):
        tiff.unpack_lzw(packed_lzw(data), n + 1)


def image_file(image, compression=1, predictor=1, rows=4, order="<", big=False):
    kind = np.dtype(image.dtype).newbyteorder(order)
    strips = []
    for k in range(0, len(image), rows):
        part = np.ascontiguousarray(image[k : k + rows], kind)
        if predictor == 2:
            whole = part.astype(part.dtype.newbyteorder("=")).view(f"u{kind.itemsize}")
            part = np.diff(whole, axis=1, prepend=np.zeros((len(part), 1), whole.dtype)).astype(np.dtype(whole.dtype).newbyteorder(order))
        raw = part.tobytes()
        if predictor == 3:
            planes = np.ascontiguousarray(part.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
        strips.append({1: raw, 5: None, 8: None}[compression] or (packed_lzw(raw) if compression == 5 else zlib.compress(raw)))
    q, size, entry, wide = ("Q", 16, 20, 8) if big else ("I", 8, 12, 4)
    at = size
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    tags = [(256, [image.shape[1]]), (257, [image.shape[0]]), (258, [8 * kind.itemsize]), (259, [compression]), (273, places), (277, [1]), (278, [rows]), (279, [len(s) for s in strips]), (317, [predictor]), (339, [{"u": 1, "i": 2, "f": 3}[kind.kind]])]
    body, field = b"".join(strips), 16 if big else 4
    lists = at
    ifd, tail = b"", b""
    for tag, values in tags:
        data = struct.pack(f"{order}{len(values)}{q}", *values)
        if len(data) > wide:
            place = lists + len(tail)
            tail += data
            data = struct.pack(f"{order}{q}", place)
        ifd += struct.pack(f"{order}HH{q}", tag, field, len(values)) + data.ljust(wide, b"\0")
    where = lists + len(tail)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, where) if big else struct.pack(f"{order}HI", 42, where))
    return head + body + tail + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + ifd + struct.pack(f"{order}{q}", 0)


def pixels(path):
    image = tiff.describe(path)
    return np.concatenate([tiff._strip(path, image, k) for k in range(len(image.offsets))])


@pytest.mark.parametrize("order, big", [("<", False), (">", False), ("<", True)])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize("kind, predictor", [("u1", 1), ("u2", 2), ("f4", 1), ("f4", 3), ("f4", 2)])
def test_codings(tmp_path, order, big, compression, kind, predictor):
    image = (np.random.default_rng(3).random((11, 9)) * 200).astype(kind)
    (tmp_path / "a.tif").write_bytes(image_file(image, compression, predictor, 4, order, big))
    assert (pixels(f"{tmp_path}/a.tif") == image).all()


def test_files_that_are_cut_or_of_another_kind(tmp_path):
    whole = image_file(np.arange(60, dtype="f4").reshape(10, 6))
    cuts = [whole[:n] for n in (0, 3, 7, 20, len(whole) - 30)]
    for k, data in enumerate([*cuts, b"XX" + whole[2:], image_file(np.arange(6, dtype="f4").reshape(1, 6), predictor=1).replace(struct.pack("<HHI", 259, 4, 1) + struct.pack("<I", 1), struct.pack("<HHI", 259, 4, 1) + struct.pack("<I", 7))]):
        (tmp_path / f"{k}.tif").write_bytes(data)
        with pytest.raises((ValueError, struct.error)):
            pixels(f"{tmp_path}/{k}.tif")


def test_surfaces_there_and_back(spark, tmp_path):
    cells = [(m, u, v, u + 0.5, v + 0.25, 10.0 * (m == "b")) for m in ("a", "b") for u in range(5) for v in range(4) if (u, v) != (2, 2)]
    df = spark.createDataFrame(cells, "mesh string, u int, v int, z double, y double, x double")
    assert tiff.write_surfaces(df, f"{tmp_path}/s", (0.5, 0.25)) == 2
    got = tiff.read_surfaces(spark, f"{tmp_path}/s", scale=2.0).collect()
    assert len(got) == 40 and sum(not r.valid for r in got) == 2
    assert sorted((r.mesh, r.u, r.v, r.z / 2, r.y / 2, r.x / 2) for r in got if r.valid) == sorted(cells)
    assert tiff.surface_scale(f"{tmp_path}/s/a") == (0.5, 0.25) and tiff.surface_scale(f"{tmp_path}/s") == (1.0, 1.0)
    one = tiff.read_surfaces(spark, f"{tmp_path}/s/a").filter("valid")
    assert one.count() == 19
    (tmp_path / "s" / "b" / "y.tif").write_bytes(tiff.encode(np.zeros((2, 2))))
    with pytest.raises(ValueError, match="different sizes"):
        tiff.read_surfaces(spark, f"{tmp_path}/s")
    (tmp_path / "s" / "b" / "y.tif").unlink()
    with pytest.raises(ValueError, match="lacks"):
        tiff.read_surfaces(spark, f"{tmp_path}/s")
    assert json.loads((tmp_path / "s" / "a" / "meta.json").read_text())["format"] == "tifxyz"


def test_many_surfaces_are_read_by_few_tasks(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 30).alias("mesh"), F.floor(F.col("id") / 30).alias("u"), F.lit(1).alias("v"), *(F.col("id").cast("double").alias(a) for a in "zyx"))
    tiff.write_surfaces(df, f"{tmp_path}/s")
    got = tiff.read_surfaces(spark, f"{tmp_path}/s").filter("valid")
    assert got.rdd.getNumPartitions() < 30
    assert {(r.mesh, r.u, r.v, r.z) for r in got.collect()} == {(str(k % 30), k // 30, 1, float(k)) for k in range(60)}


def test_images_of_a_surface_may_have_strips_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "PART_STRIPS", 1)
    (tmp_path / "s" / "a").mkdir(parents=True)
    grid = np.arange(40.0).reshape(10, 4)
    for a, rows in (("z", 3), ("y", 4), ("x", 64)):
        (tmp_path / "s" / "a" / f"{a}.tif").write_bytes(tiff.encode(grid, rows))
    got = {(r.v, r.u): (r.z, r.y, r.x) for r in tiff.read_surfaces(spark, f"{tmp_path}/s").collect()}
    assert got == {(k // 4, k % 4): (float(k),) * 3 for k in range(40)}
