"""Sharded arrays of version 3, archives with a ledger, and scores on analytic masks."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminae.operators import frames, review
from laminae.session import running_sums
from laminae.sources import archive, zarr


def as_block(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


def _shard(block, inner, absent):
    bodies, index, at = [], [], 0
    counts = [a // b for a, b in zip(block.shape, inner)]
    for k in range(int(np.prod(counts))):
        corner = [int(i) * n for i, n in zip(np.unravel_index(k, counts), inner)]
        if k in absent:
            index += [zarr.ABSENT, zarr.ABSENT]
            continue
        body = gzip.compress(np.ascontiguousarray(block[tuple(slice(c, c + n) for c, n in zip(corner, inner))]).tobytes())
        index += [at, len(body)]
        bodies.append(body)
        at += len(body)
    return b"".join(bodies) + np.array(index, "<u8").tobytes() + b"\0\0\0\0"


def test_zarr_three_with_shards(spark, tmp_path):
    rng = np.random.default_rng(1)
    block = rng.integers(1, 99, (8, 8, 16)).astype("<u2")
    inner = {"chunk_shape": [4, 4, 4], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}
    meta = {"zarr_format": 3, "node_type": "array", "shape": [8, 8, 16], "data_type": "uint16", "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [8, 8, 8]}}, "chunk_key_encoding": {"name": "default"}, "codecs": [{"name": "sharding_indexed", "configuration": inner}]}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    for k in range(2):
        (tmp_path / f"c/0/0/{k}").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"c/0/0/{k}").write_bytes(_shard(block[..., 8 * k : 8 * k + 8], (4, 4, 4), {3} if k else set()))
    want = block.astype(float)
    want[0:4, 4:8, 12:16] = 0
    assert (as_block(zarr.read_box(spark, str(tmp_path)), block.shape) == want).all()
    part = zarr.read_box(spark, str(tmp_path), (0, 0, 9), (8, 3, 16))
    assert part.count() == 8 * 3 * 7 and part.filter("x < 9 or y >= 3").isEmpty()
    assert zarr.read_box(spark, str(tmp_path), (0, 0, 0), (0, 0, 0)).count() == 0
    (tmp_path / "c/0/0/1").write_bytes(b"short")
    with pytest.raises(Exception, match="shorter than its index"):
        zarr.read_box(spark, str(tmp_path)).collect()


def test_archive_commits_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(z), int(y), int(x), float(rng.integers(1, 200))) for z in range(10) for y in range(9) for x in range(11) if (z + y + x) % 3]
    rows += [(20, 20, 20, 0.0)]
    vox = spark.createDataFrame(rows, "z long, y long, x long, v double")
    path = str(tmp_path / "a")
    archive.write(vox.filter("z < 4"), path, 4)
    wanted = vox.select(*(F.floor(F.col(a) / 4).alias(f"c{a}") for a in "zyx"))
    left = archive.pending(wanted, spark, path)
    assert left.filter("cz = 0").isEmpty() and left.count() == 9 * 2 + 1
    rest = vox.select("*", *(F.floor(F.col(a) / 4).alias(f"c{a}") for a in "zyx")).join(left, ["cz", "cy", "cx"], "left_semi").select(*"zyx", "v")
    archive.write(rest, path, 4)
    same = lambda df: sorted(tuple(r) for r in df.collect())
    assert same(archive.read(spark, path)) == sorted(rows)
    assert same(archive.read(spark, path, (3, 2, 1), (9, 8, 7))) == sorted(r for r in rows if 3 <= r[0] < 9 and 2 <= r[1] < 8 and 1 <= r[2] < 7)
    assert {r.state for r in archive.ledger(spark, path).filter("cz = 5").collect()} == {"ZERO"}
    # data of a write that was never committed is not seen
    archive.write(vox.limit(0), path, 4)
    spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data").limit(3).withColumn("n", F.lit(7).cast("long")).write.parquet(f"{path}/data/lost")
    assert same(archive.read(spark, path)) == sorted(rows)
    archive.transcode(spark, path, str(tmp_path / "b"), 8, "<u2")
    archive.transcode(spark, path, str(tmp_path / "b"), 8, "<u2")
    assert same(archive.read(spark, str(tmp_path / "b"))) == sorted(rows) and archive.describe(spark, str(tmp_path / "b"))["side"] == 8
    points = spark.createDataFrame([(1, -4.0, 0.0, 1.0), (2, 9.0, 99.0, 0.0), (3, 3.2, 3.9, 3.0)], "id long, z double, y double, x double")
    table = {r[:3]: r[3] for r in rows}
    got = {r.id: r.value for r in archive.gather(points, spark, path, (10, 9, 11)).collect()}
    assert got == {1: table[0, 0, 1], 2: table.get((9, 8, 0), 0.0), 3: table.get((3, 3, 3), 0.0)}


def test_mask_score(spark):
    cells = lambda ok: spark.createDataFrame([(z, y, x) for z in range(10) for y in range(10) for x in range(10) if ok(z, y, x)], "z long, y long, x long")
    box = cells(lambda z, y, x: 2 <= min(z, y, x) and max(z, y, x) < 7)
    holed = cells(lambda z, y, x: 2 <= min(z, y, x) and max(z, y, x) < 7 and (z, y, x) != (4, 4, 4))
    row = review.mask_score(box, box, (10, 10, 10)).first()
    assert (row.nsd, row.split, row.merge, row.topo, row.score) == pytest.approx((1, 0, 0, 1, 1))
    row = review.mask_score(holed, box, (10, 10, 10)).first()
    assert row.topo == pytest.approx(0.34 / 0.67) and row.score < 1


def test_lookup_and_zip_errors(spark):
    rows, source = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, name string")
    with pytest.raises(Exception, match="no name for k 2"):
        review.matched(rows, source, "k", "name").collect()
    lists = spark.createDataFrame([(1, [1, 2], [3])], "id long, p array<int>, g array<int>")
    with pytest.raises(Exception, match="differ in length"):
        review.zipped(lists, "p", "g", ["id"]).collect()


def test_peaks_prefer_the_nearest(spark):
    rows = [(1, [0, 9, 0, 5, 0, 0, 8]), (2, [1, 1, 1, 1, 1, 1, 1]), (3, [5, 4]), (4, [9, 1, 1, 2, 1, 1, 9])]
    got = {r.id: r.t for r in frames.prominent_peaks(spark.createDataFrame(rows, "id long, values array<int>"), ["id"], 3, 2, 3.0).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: None}


def test_running_sums(spark):
    rows = [(k * 7 % 1000, k % 13) for k in range(1000)]
    df, total = running_sums(spark.createDataFrame(rows, "k long, n long").repartition(5), ["k"], ["n"])
    at, want = 0, {}
    for k, n in sorted(rows):
        at += n
        want[k] = at
    assert {r.k: r.n_upto for r in df.collect()} == want and total == {"n": at}
    none, empty = running_sums(spark.createDataFrame([], "k long, n long"), ["k"], ["n"])
    assert none.count() == 0 and empty == {"n": 0}
