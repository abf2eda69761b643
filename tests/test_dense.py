"""Chunked numerics against whole-volume numpy, sources, recipes and stateful streams."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminae.operators import dense, filters, graph, mesh, patches
from laminae.plans import recipes
from laminae.sources import texts, zarr
from laminae.streaming import state


@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(5)
    block = rng.integers(0, 50, (9, 12, 14)).astype(float)
    rows = [(int(z), int(y), int(x), float(v)) for (z, y, x), v in np.ndenumerate(block)]
    return block, spark.createDataFrame(rows, "z long, y long, x long, v double")


def as_block(df, shape, name="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("side", [4, 5, 32])
def test_blur_does_not_see_chunks(volume, side):
    block, vox = volume
    half = 3
    want = dense.blur(np.pad(block, half, mode="symmetric"), 1.0)[half:-half, half:-half, half:-half]
    got = as_block(dense.gaussian_blur(vox, 1.0, side, block.shape), block.shape)
    assert np.allclose(got, want)


@pytest.mark.parametrize("side", [4, 32])
def test_plateness_does_not_see_chunks(volume, side):
    block, vox = volume
    sigmas = [1.0, 1.5]
    want = np.zeros(block.shape)
    inner = tuple(slice(1, -1) for _ in range(3))
    for sigma in sigmas:
        half = 6
        ratio, strength = (x[half:-half, half:-half, half:-half] for x in dense.plate_terms(np.pad(block, half, mode="symmetric"), sigma))
        c = 0.5 * np.abs(strength[inner]).max()
        plate = np.where(strength > 0, np.exp(-(ratio**2) / 0.5) * (1 - np.exp(-(strength**2) / (2 * c * c))), 0)
        want[inner] = np.maximum(want, plate)[inner]
    got = as_block(dense.hessian_plateness(vox, sigmas, side, block.shape), block.shape, "plate")
    assert np.allclose(got, want) and want.max() > 0.1


def test_plateness_of_a_bright_sheet(spark):
    none = spark.createDataFrame([], "z long, y long, x long")
    vox = graph.background(none, (12, 12, 12)).withColumn("v", F.when(F.col("x") == 6, 100.0).otherwise(0.0))
    got = as_block(dense.hessian_plateness(vox, [1.0], 6, (12, 12, 12)), (12, 12, 12), "plate")
    assert got[5, 5, 6] > 0.8 and got[5, 5, 9] < 0.05 and got[0].max() == 0


@pytest.mark.parametrize("side", [5, 32])
def test_coherence_diffusion_does_not_see_chunks(volume, side):
    block, vox = volume
    want = dense.along_sheets(block, 2, 0.12, 0.5, 1.0, 0.05)
    got = as_block(dense.coherence_diffusion(vox, 2, 0.12, side, block.shape), block.shape)
    assert np.allclose(got, want)


def test_coherence_diffusion_smooths_along_sheets(spark):
    rng = np.random.default_rng(2)
    block = (np.arange(16) % 8 < 4)[None, None, :] * 100.0 + rng.normal(0, 5, (10, 10, 16))
    rows = [(int(z), int(y), int(x), float(v)) for (z, y, x), v in np.ndenumerate(block)]
    got = as_block(dense.coherence_diffusion(spark.createDataFrame(rows, "z long, y long, x long, v double"), 6, 0.12, 16, block.shape), block.shape)
    assert got[..., 5].std() < 0.8 * block[..., 5].std() and got[..., 2].mean() - got[..., 5].mean() > 80


def test_structure_tensor_of_sheets(spark):
    vox = graph.background(spark.createDataFrame([], "z long, y long, x long"), (8, 8, 16)).withColumn("v", (F.col("x") % 8 < 4).cast("int") * 100)
    rows = dense.structure_tensor(vox, 1.0, 8, (8, 8, 16)).filter("x = 8 and z = 4").collect()
    assert all(abs(r.nx) > 0.99 and r.sheetness > 0.9 for r in rows)


def test_distances(spark):
    none = spark.createDataFrame([], "z long, y long, x long")
    seeds = spark.createDataFrame([(8, 8, 8)], "z long, y long, x long")
    rows = {(r.z, r.y, r.x): r.d2 for r in dense.distance_squared(seeds, graph.background(none, (13, 13, 13))).collect()}
    assert (rows[8, 8, 10], rows[5, 8, 8], rows[8, 11, 12]) == (4, 9, 25)
    assert dense.distance_squared(none, graph.background(none, (2, 2, 2))).filter("d2 is not null").count() == 0


def test_windings_of_a_chain(spark):
    nodes = spark.range(5)
    edges = spark.createDataFrame([(k, k + 1, 1, 1.0) for k in range(4)], "a long, b long, dwrap long, certainty double")
    w = {r.id: r.winding for r in patches.integer_windings(nodes, edges).collect()}
    assert [w[k + 1] - w[k] for k in range(4)] == [1, 1, 1, 1]


def test_phantom(spark):
    assert patches.phantom(spark, (4, 16, 16), 6.0).agg(F.max("v")).first()[0] <= 248


def test_triangle_normals(spark):
    lines = ["v 0 0 0", "v 1 0 0", "v 0 1 0", "v 1 1 0", "f 1 2 4 3", "f -4/1 -3/2 -2/3"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    vertices, faces = texts.triangles(df)
    assert sorted(map(tuple, faces.collect())) == [(1, 2, 3), (1, 2, 4), (1, 4, 3)]
    normals = mesh.triangle_normals(faces.withColumn("mesh", F.lit(0)), vertices.withColumn("mesh", F.lit(0))).collect()
    assert len(normals) == 4 and all(r.ny == 0 and r.nx == 0 for r in normals)
    bad = spark.createDataFrame([(0, "v 0 0 0"), (1, "f 1 2 3")], "n long, value string")
    with pytest.raises(Exception, match="bad face"):
        texts.triangles(bad)[1].collect()


def test_zarr_box(spark, tmp_path):
    block = np.arange(6 * 8 * 10, dtype="<u2").reshape(6, 8, 10)
    root = tmp_path / "a"
    root.mkdir()
    meta = {"zarr_format": 2, "shape": [6, 8, 10], "chunks": [4, 4, 4], "dtype": "<u2", "compressor": {"id": "zlib"}, "fill_value": 7, "order": "C", "filters": None}
    (root / ".zarray").write_text(json.dumps(meta))
    for z in range(2):
        for y in range(2):
            for x in range(3):
                if (z, y, x) != (1, 1, 1):
                    part = np.zeros((4, 4, 4), "<u2")
                    piece = block[4 * z : 4 * z + 4, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
                    part[: piece.shape[0], : piece.shape[1], : piece.shape[2]] = piece
                    (root / f"{z}.{y}.{x}").write_bytes(zlib.compress(part.tobytes()))
    vox = zarr.read_box(spark, str(root))
    want = block.astype(float)
    want[4:6, 4:8, 4:8] = 7
    assert (as_block(zarr.filled(vox, (6, 8, 10), 7), (6, 8, 10)) == want).all()
    inner = zarr.read_box(spark, str(root), (1, 2, 3), (5, 6, 9))
    assert inner.count() == 4 * 4 * 6 - 1 * 2 * 4 and inner.agg(F.min("z"), F.max("x")).first() == (1, 8)
    (root / "0.0.0").write_bytes(zlib.compress(b"short"))
    with pytest.raises(Exception, match="bytes"):
        zarr.read_box(spark, str(root)).collect()


def test_registry_fails_on_a_bad_line(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"k": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        texts.registry(spark, str(tmp_path / "r.jsonl"), "k long").collect()


def test_pair_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# comment\ns1 c1 4 5 6 um=2.4 shift=1\ns2 c2\n\n")
    rows = {r.surf: r for r in texts.pairs(spark, str(tmp_path / "p.txt")).collect()}
    assert rows["s1"].options == {"um": "2.4", "shift": "1"} and rows["s1"].rest == ["4", "5", "6"] and rows["s2"].ct == "c2"


def test_recipe(spark, volume):
    _, vox = volume
    out = recipes.run('[[stage]]\nname = "crop"\nlow = [0, 0, 0]\nhigh = [4, 4, 4]\n[[stage]]\nname = "threshold"\nt = 25.0\n[[stage]]\nname = "components"\nshape = [4, 4, 4]\n', vox)
    assert out.columns == ["z", "y", "x", "v"] and 0 < out.count() < 64
    with pytest.raises(KeyError):
        recipes.parse('[[stage]]\nname = "nothing"\n')


def test_ledger_stream(spark, tmp_path):
    rows = [(1, "claim", 1), (1, "done", 2), (1, "claim", 3), (2, "claim", 1), (2, "fail", 2), (2, "claim", 3), (3, "done", 1)]
    spark.createDataFrame(rows, "item long, kind string, seq long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("item long, kind string, seq long").json(str(tmp_path / "in"))
    seen = {}
    run = state.ledger(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    run.foreachBatch(lambda df, _: seen.update({r.item: (r.state, r.tries) for r in df.collect()})).start().awaitTermination()
    assert seen == {1: ("DONE", 1), 2: ("CLAIMED", 2), 3: ("QUEUED", 0)}


def test_floor_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, value double"
    for k, rows in enumerate([[("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:30:00", 2.0)], [("2024-01-01 01:30:00", 4.0)], [("2024-01-01 00:02:00", 9.0), ("2024-01-01 03:00:00", 1.0)]]):
        spark.createDataFrame(rows, "ts string, value double").selectExpr("cast(ts as timestamp) ts", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = []
    run = state.finalized(stream, "ts", "10 minutes", "0 seconds").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    run.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).start().awaitTermination()
    first = [r for r in out if r[0].minute == 0 and r[0].hour == 0]
    assert len(first) == 1 and first[0][1:] == (1, 1.0)


def test_diffusion_deals_a_voxel_to_few_chunks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dense, "on_chunks", lambda vox, work, outputs, side, halo, shape, mirrored=True: seen.append((side, halo)))
    dense.coherence_diffusion(None, 3, 0.12, 8, (16, 32, 32))
    (side, halo) = seen[0]
    assert side >= 2 * halo


def test_guided_filter_sees_a_voxel_in_few_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    shape = (9, 10, 11)
    v = draw.integers(1, 50, shape).astype(float)
    live = draw.random(shape) < 0.7
    at = np.argwhere(live)
    df = spark.createDataFrame([(*map(int, p), float(v[tuple(p)])) for p in at], "z long, y long, x long, v double")
    monkeypatch.setattr(filters, "shifted", None)  # no copy of a voxel for every neighbour
    got = {(r.z, r.y, r.x): r.v for r in filters.guided(df, 100.0, shape, side=4).collect()}

    def means(*fields):
        wide = [np.pad(np.where(live, f, np.nan), 1, mode="edge") for f in fields]
        return [np.nanmean([w[i : i + 9, j : j + 10, k : k + 11] for i in range(3) for j in range(3) for k in range(3)], axis=0) for w in wide]

    m, mm = means(v, v * v)
    a = (mm - m * m) / (mm - m * m + 100.0)
    ma, mb = means(a, m * (1 - a))
    assert got == {tuple(p): pytest.approx((ma * v + mb)[tuple(p)], abs=1e-9) for p in at.tolist()}


@pytest.mark.parametrize("steps", [2, 64])
def test_bundles_of_lines_find_the_nearest(steps):
    draw = np.random.default_rng(6)
    lines = np.where(draw.random((40, 90)) < 0.04, draw.integers(0, 50, (40, 90)).astype(float), np.inf)
    lines[3] = np.inf
    at = np.arange(90)
    want = ((at[:, None] - at[None, :]) ** 2 + lines[:, None, :]).min(-1)
    assert np.array_equal(dense._nearer(lines, steps), want)


def test_distances_over_bundles_and_gaps(spark):
    draw = np.random.default_rng(7)
    shape = (7, 11, 10)
    at = np.indices(shape).reshape(3, -1).T
    seeds = at[draw.random(len(at)) < 0.02]
    there = at[draw.random(len(at)) < 0.5]
    table = [spark.createDataFrame(p.tolist(), "z long, y long, x long") for p in (seeds, there)]
    whole = graph.background(table[0].limit(0), shape)
    got = {(r.z, r.y, r.x): r.d2 for r in dense.distance_squared(table[0], whole, bundle=4).join(table[1], ["z", "y", "x"], "left_semi").collect()}
    assert got == {tuple(p): float(((seeds - p) ** 2).sum(1).min()) for p in there.tolist()}
