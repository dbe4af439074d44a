"""Analytic scenes and properties of the operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelloom.functions import geometry as G
from voxelloom.functions import scalars as S
from voxelloom.operators import dense, evaluate, fusion, grid, image, learn, mesh, sampling
from voxelloom.sources import grids_io, manifests, mesh_files, rasters
from voxelloom.streaming import fusion as streams

GRID = "scene_id long, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>"
FRAMES = "scene_id long, frame_id int, h int, w int, k array<double>, h_mat array<double>"


def floats(*x):
    return [float(v) for v in x]


def one_grid(spark, n=(6, 5, 4), size=0.25, origin=(1.0, -2.0, 0.5), angle=0.3):
    c, s = np.cos(angle), np.sin(angle)
    return spark.createDataFrame([(1, *n, size, [float(x) for x in origin], [float(x) for x in (c, -s, 0, s, c, 0, 0, 0, 1)])], GRID)


def test_index_to_world_and_back(spark):
    g = one_grid(spark)
    back = grid.locate(grid.world_centres(g).withColumnsRenamed({"i": "a", "j": "b", "k": "c"}), g)
    assert back.where("i <> a OR j <> b OR k <> c OR NOT inside").count() == 0 and back.count() == 120


def test_projection_inverts(spark):
    pose = np.eye(4)
    pose[:3, :3] = np.linalg.qr(np.random.default_rng(1).standard_normal((3, 3)))[0]
    pose[:3, 3] = (0.5, -1, 2)
    df = spark.createDataFrame([(3.0, 4.0, 1.5, floats(30, 0, 8, 0, 31, 6, 0, 0, 1), pose.ravel().tolist())], "u double, v double, d double, k array<double>, h array<double>")
    world = df.select("*", *(c.alias(n) for c, n in zip(G.camera_to_world(G.unproject_camera(F.col("u"), F.col("v"), F.col("d"), F.col("k")), F.col("h")), "xyz", strict=True)))
    again = world.select(*(c.alias(n) for c, n in zip(G.project(G.columns("x", "y", "z"), F.col("k"), G.inverse_pose(F.col("h"))), "pqr", strict=True))).first()
    assert np.allclose(tuple(again), (3, 4, 1.5))


def sphere_scene(spark, n=16, radius=0.3):
    """A sphere seen from the front: exact depth by rays, exact distance by formula."""
    g = spark.createDataFrame([(1, n, n, n, 1 / n, [-0.5, -0.5, -0.5], floats(1, 0, 0, 0, 1, 0, 0, 0, 1))], GRID)
    pose = np.eye(4)
    pose[2, 3] = -2.0
    h = w = 64
    k = [120.0, 0, 31.5, 0, 120.0, 31.5, 0, 0, 1]
    rows = []
    for r, c in itertools.product(range(h), range(w)):
        ray = np.array([(c - 31.5) / 120, (r - 31.5) / 120, 1.0])
        a, b, q = ray @ ray, -2 * ray[2] * 2.0, 4 - radius**2
        disc = b * b - 4 * a * q
        if disc >= 0:
            rows.append((1, 0, r, c, float((-b - np.sqrt(disc)) / (2 * a))))
    frames = spark.createDataFrame([(1, 0, h, w, [float(x) for x in k], pose.ravel().tolist())], FRAMES)
    return g, frames, spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double")


def test_fused_sphere_has_the_right_signs(spark):
    g, frames, pixels = sphere_scene(spark)
    centres = grid.world_centres(g)
    fused = fusion.fuse(fusion.observe(centres, frames, pixels), 0.2).join(centres, grid.CELL).collect()
    near = [r for r in fused if abs(np.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2) - 0.3) > 0.1 and r["z"] < 0]
    assert len(near) > 50
    assert all((r["v"] < 0) == (np.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2) < 0.3) for r in near)


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Pixels in four files, the stream stopped after two and started again from its checkpoint; then a scene ends."""
    g, frames, pixels = sphere_scene(spark)
    prior = grid.grid_cells(g).where("k = 3").select(*grid.CELL, F.lit(0.125).alias("v"))
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows = pixels.withColumn("part", F.xxhash64("row", "col") % 4)
    both = []
    for started in (None, prior):
        folder = f"{out}{started is not None}"
        for n, parts in enumerate(((0, 1, -1), (2, 3, -2, -3))):
            for k in parts:
                rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{source}{started is not None}")
            stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}{started is not None}")
            got = {(r["i"], r["j"], r["k"]): (r["v"], r["sum_w"]) for r in streams.run_to_end(streams.fuse_stream(stream, g, frames, 0.2, started, tile=8, band_rows=20), folder).collect()}
        want = {(r["i"], r["j"], r["k"]): (r["v"], r["sum_w"]) for r in fusion.fuse_grid(g, frames, pixels, 0.2, prior=started).where("n_frames > 0").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)
        both.append(got)
    assert both[0] != both[1]
    end = spark.createDataFrame([(1, 0, -1, 0, None)], pixels.schema)
    for late in (end, pixels.limit(50)):
        late.coalesce(1).write.mode("append").parquet(f"{source}False")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}False")
    after = streams.run_to_end(streams.fuse_stream(stream, g, frames, 0.2, tile=8, band_rows=20), f"{out}False").collect()
    assert {(r["i"], r["j"], r["k"]): (r["v"], r["sum_w"]) for r in after} == both[0]  # what came after the end is ignored


def test_plane_normals(spark):
    """z = 1 + x / 2 in camera space."""
    k = floats(8, 0, 4, 0, 8, 3, 0, 0, 1)
    rows = [(1, 0, r, c, 1 / (1 - 0.5 * (c - 4) / 8)) for r in range(6) for c in range(8)]
    frames = spark.createDataFrame([(1, 0, 6, 8, k, np.eye(4).ravel().tolist())], FRAMES)
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double")
    want = np.array([0.5, 0, -1]) / np.sqrt(1.25)
    got = image.normals(pixels, frames).collect()
    inner = [r for r in got if 0 < r["row"] < 5 and 0 < r["col"] < 7]
    assert len(got) == 48 and all(np.allclose(np.abs([r["nx"], r["ny"], r["nz"]]), np.abs(want), atol=1e-6) for r in inner)


def test_curvature_of_a_paraboloid(spark):
    frames = spark.createDataFrame([(1, 0, 9, 9, floats(1, 0, 0, 0, 1, 0, 0, 0, 1), np.eye(4).ravel().tolist())], FRAMES)
    rows = [(1, 0, r, c, 10 + ((r - 4) ** 2 + 2 * (c - 4) ** 2) / 2.0) for r in range(9) for c in range(9)]
    got = image.curvature(spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double"), frames).where("row = 4 AND col = 4").first()
    assert np.allclose([got["h_mean"], got["k_gauss"], got["z_row_row"], got["z_col_col"]], [-1.5, 2, 1, 2])


def test_distance_transform_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    solid = rng.random((5, 6, 4)) < 0.2
    at = np.argwhere(np.ones_like(solid))
    rows = [(1, *map(int, c), bool(solid[tuple(c)])) for c in at] + [(2, *map(int, c), True) for c in at]
    got = dense.signed_distance(spark.createDataFrame(rows, "scene_id long, i int, j int, k int, solid boolean"), 0.5).collect()
    for r in got:
        c = np.array([r["i"], r["j"], r["k"]])
        if r["scene_id"] == 2:
            assert r["v"] is None
            continue
        other = at[solid[tuple(at.T)] != solid[tuple(c)]]
        d = np.sqrt(((other - c) ** 2).sum(1).min()) * 0.5
        assert abs(r["v"] - (-d if solid[tuple(c)] else d)) < 1e-12


def test_segmentation_dilates_in_label_order():
    plan = np.zeros((20, 20), bool)
    plan[3:8, 3:8] = True
    plan[3:8, 12:17] = True
    labels = dense.segment_plan(plan, 5)
    assert labels[5, 5] == 1 and labels[5, 14] == 2
    assert labels[5, 9] == 2  # both reach it; the later label owns it
    assert labels[19, 19] == 0


def test_components_are_eight_connected():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert dense.label_components(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3]]


def test_filters_keep_holes_and_constants(spark):
    rows = [(1, 0, r, c, None if (r, c) == (2, 2) else 1.5) for r in range(6) for c in range(7)]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double")
    for f in (image.bilateral_depth, image.median_depth):
        got = {(r["row"], r["col"]): r["depth"] for r in f(pixels).collect()}
        assert got.pop((2, 2)) is None and np.allclose(list(got.values()), 1.5)
    x = np.arange(30.0).reshape(5, 6)
    padded = np.pad(x, ((1, 1), (1, 1)), mode="symmetric")
    assert image.median_filter(x, 3)[2, 3] == np.median(padded[2:5, 3:6])


def test_filters_equal_plain_loops(spark):
    """Both filters over frames with holes, which the nearest known pixel fills for the filter only."""
    rng = np.random.default_rng(12)
    h, w = 13, 11
    frames = {f: np.where(rng.random((h, w)) < 0.15, np.nan, rng.uniform(0.2, 3.0, (h, w))) for f in range(2)}
    rows = [(1, f, r, c, None if np.isnan(x[r, c]) else float(x[r, c])) for f, x in frames.items() for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double")
    median = {(r["frame_id"], r["row"], r["col"]): r["depth"] for r in image.median_depth(pixels, 4).collect()}
    smooth = {(r["frame_id"], r["row"], r["col"]): r["depth"] for r in image.bilateral_depth(pixels, 60.0, 1.5).collect()}
    mirrored = lambda n, size: -n - 1 if n < 0 else 2 * size - 1 - n if n >= size else n
    for f, x in frames.items():
        known = np.argwhere(~np.isnan(x))
        full = np.array([[x[tuple(known[((known - (r, c)) ** 2).sum(1).argmin()])] for c in range(w)] for r in range(h)])
        scale = max(1.0, full.max())
        for r, c in itertools.product(range(h), range(w)):
            if np.isnan(x[r, c]):
                assert median[f, r, c] is None and smooth[f, r, c] is None
                continue
            around = sorted(full[mirrored(r + a, h), mirrored(c + b, w)] for a in range(-2, 2) for b in range(-2, 2))
            assert median[f, r, c] == around[8]
            total = weight = 0.0
            for a, b in itertools.product(range(-3, 4), repeat=2):
                other = full[min(max(r + a, 0), h - 1), min(max(c + b, 0), w - 1)]
                own = np.exp(-(a * a + b * b) / (2 * 1.5**2)) * np.exp(-(((other - full[r, c]) / scale * 255) ** 2) / (2 * 60.0**2))
                total, weight = total + own * other, weight + own
            assert smooth[f, r, c] == pytest.approx(total / weight)


def test_sampling_is_a_function_of_the_seed(spark):
    rows = [(s, 0, r, c, float(r + c + 1)) for s in (1, 2) for r in range(8) for c in range(9)]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double")
    key = ["scene_id", "frame_id", "sample_id", "row", "col"]
    draw = lambda df, seed: sorted(map(tuple, sampling.weighted(df, F.col("depth"), 200, seed).select(key).collect()))
    a = draw(pixels, 3)
    assert len(a) == 400 and a == draw(pixels.repartition(5), 3) and a != draw(pixels, 4)
    heavy = [r for r in a if r[3] + r[4] >= 8]
    assert 0.5 < len(heavy) / 400 < 0.85  # two thirds of the weight
    none = sampling.weighted(pixels.withColumn("depth", F.lit(0.0)), F.col("depth"), 5, 1)
    assert none.count() == 0 and sampling.frames_without_weight(pixels.select("scene_id", "frame_id").distinct(), none).count() == 2
    u = spark.range(20_000).select(S.uniform(F.col("id"), 1).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.01 and 0 <= u[1] and u[2] < 1


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5)) @ np.diag([9, 5, 2, 0.5, 0.1]) @ rng.standard_normal((5, 12)) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(5)
    mean, parts = learn.fit_pca(df, "x", 3)
    assert np.allclose(mean, x.mean(0))
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert all(abs(abs(a @ b) - 1) < 1e-6 for a, b in zip(parts, axes[:3], strict=True))
    back = learn.pca_inverse(learn.pca_transform(df, "x", "code", mean, parts), "code", "out", mean, parts).toPandas()
    assert np.abs(np.stack(back["out"]) - np.stack(back["x"])).mean() < 0.5


def test_forest_nodes_are_consistent_and_learn(spark):
    rng = np.random.default_rng(8)
    x = rng.random((400, 6))
    y = np.stack([np.where(x[:, 2] > 0.5, 5.0, -5.0)] * 4, 1) + rng.standard_normal((400, 4)) * 0.1
    rows = [(t, k, x[k].tolist(), y[k].tolist()) for t in range(2) for k in range(400)]
    df = spark.createDataFrame(rows, "tree_id int, example_id long, x array<double>, y array<double>")
    nodes = learn.train_forest(df, "m", tests=100, depth=3, pca_dims=4)
    found = {(r["tree_id"], r["node_id"]): r for r in nodes.collect()}
    for (t, n), r in found.items():
        if not r["is_leaf"]:
            assert found[t, 2 * n + 1]["num_exs"] + found[t, 2 * n + 2]["num_exs"] == r["num_exs"]
    assert all(found[t, 0]["medoid_id"] == 0 and found[t, 0]["impurity"] == 0.5 for t in (0, 1))
    queries = df.where("tree_id = 0").select("example_id", "x")
    a, b = (sorted(map(tuple, d.select("example_id", "tree_id", "node_id", "medoid_id").collect())) for d in (learn.apply_forest(queries, nodes, "example_id", "x"), learn.apply_forest_joins(queries, nodes, "example_id", "x", 4)))
    assert a == b
    assert np.mean([np.sign(y[m][0]) == np.sign(y[e][0]) for e, _, _, m in a]) > 0.95
    dims = {r["dim"]: r["importance"] for r in learn.importance(nodes).collect()}
    assert not dims or max(dims, key=dims.get) is not None


def test_nearest_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(9)
    data = np.round(rng.random((60, 4)), 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "id long, x array<double>")
    q = df.selectExpr("id AS q", "x")
    one, many = ({r["q"]: (r["nn_id"], round(r["dist"], 9)) for r in learn.nearest(q, df, "q", "id", "x", n).collect()} for n in (1000, 9))
    assert one == many and all(nn == min(k for k in range(60) if (data[k] == data[a]).all()) for a, (nn, _) in one.items())


def test_iso_surface_of_a_sphere(spark):
    n = 12
    g = spark.createDataFrame([(1, n, n, n, 1 / n, [-0.5, -0.5, -0.5], floats(1, 0, 0, 0, 1, 0, 0, 0, 1))], GRID)
    v = grid.world_centres(g).select("scene_id", "i", "j", "k", (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 0.3).alias("v"))
    vertices, faces = mesh.indexed(mesh.iso_triangles(v, g))
    r = [np.sqrt(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2) for p in vertices.collect()]
    assert len(r) > 100 and max(abs(np.array(r) - 0.3)) < 0.02
    edges = {}
    for f in faces.collect():
        for a, b in ((0, 1), (1, 2), (2, 0)):
            e = frozenset((f[f"v{a}"], f[f"v{b}"]))
            edges[e] = edges.get(e, 0) + 1
    assert {n for e, n in edges.items() if len(e) == 2} == {2}  # closed


def test_blocks_placed_back_are_the_grid(spark):
    g = spark.createDataFrame([(1, 8, 8, 8, 0.125, floats(0, 0, 0), floats(1, 0, 0, 0, 1, 0, 0, 0, 1))], GRID)
    v = grid.grid_cells(g).select("scene_id", "i", "j", "k", (F.col("i") * 64 + F.col("j") * 8 + F.col("k")).cast("double").alias("v"))
    rot, origin = G.block_frame([F.lit(0.5)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)], (4, 4, 4), 0.125, (0.5, 0.5, 0.5), False)
    blocks = spark.range(1).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("sample_id"), rot.alias("rot"), origin.alias("origin"))
    cut = blocks.join(dense.cut_blocks(blocks, v, g, (4, 4, 4), 0.125), ["scene_id", "sample_id"]).withColumn("w", F.lit(2.0))
    placed = grid.average(dense.place_predictions(cut, g, (4, 4, 4), 0.125)).join(v.withColumnRenamed("v", "t"), grid.CELL)
    assert placed.count() == 64 and placed.where("v <> t OR n <> 1").count() == 0


def test_scores_of_known_grids(spark):
    rows = [(1, 0, 0, k, -1.0 if k < 4 else 1.0) for k in range(6)] + [(1, 0, 0, 6, None)]
    truth = spark.createDataFrame(rows, "scene_id long, i int, j int, k int, v double")
    guess = truth.where("k <> 0").withColumn("v", F.when(F.col("k") < 5, -1.0).otherwise(1.0))
    r = evaluate.confusion(guess, truth, truth, 0.1).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 2, 1) and r["iou"] == 0.5
    scores = spark.createDataFrame([("a", 1, 0.5, 1.0, 0.0), ("a", 2, None, None, None), ("b", 1, 0.25, 0.0, 1.0)], "test string, scene_id int, iou double, precision double, recall double")
    means = {m["test"]: (m["n"], m["iou"]) for m in evaluate.mean_scores(scores, 1).collect()}
    assert means == {"a": (1, 0.5), "b": (1, 0.25)} and evaluate.mean_scores(scores, 2).where("iou IS NOT NULL").count() == 0


def test_rasters_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    depth, mask = rng.integers(0, 65536, (5, 9)), rng.random((4, 11)) < 0.5
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "d.pgm").write_bytes(rasters.encode_pgm(depth))
    assert (rasters.decode_raster(rasters.encode_pbm(mask)) == mask).all()
    assert (rasters.decode_raster(b"P5\n# made by hand\n2 1\n255\n\x01\xff") == [[1, 255]]).all()
    got = rasters.read_rasters(spark, str(tmp_path / "s1" / "d.pgm"), "raw").toPandas()
    assert (got.sort_values(["row", "col"])["raw"].to_numpy().reshape(5, 9) == depth).all() and set(got["file"]) == {"s1/d.pgm"}
    with pytest.raises(ValueError):
        rasters.decode_raster(b"P6\n1 1\n255\nabc")


def test_grid_files_and_manifests(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    v = np.arange(24.0).reshape(2, 3, 4)
    v[0, 0, 1] = np.nan
    (tmp_path / "s1" / "g.dat").write_bytes(v.astype("<f2").tobytes())
    (tmp_path / "s1" / "g.yaml").write_text("R: [[1, 0, 0], [0, 1, 0], [0, 0, 1]]\nT: [0, 0, 1]\nvoxelsize: 0.5\nshape: [2, 3, 4]\n")
    meta = grids_io.read_grid_meta(spark, str(tmp_path / "s1" / "g.yaml"), "tsdf").first()
    assert (meta["scene_id"], meta["vox_size"], meta["origin"]) == ("s1", 0.5, [0.0, 0.0, 1.0])
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in grids_io.read_dumps(spark, str(tmp_path), data="g.dat", meta="g.yaml").collect()}
    assert len(got) == 24 and got[0, 0, 1] is None and got[1, 2, 3] == 23
    (tmp_path / "s1" / "poses.yaml").write_text("- {id: 7, image: a.pgm, intrinsics: [[1, 0, 2], [0, 1, 2], [0, 0, 1]], pose: [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], depth_scaling: 2}\n- {id: 8, image: b.pgm, intrinsics: [[1, 0, 2], [0, 1, 2], [0, 0, 1]], pose: [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], mask: m.pbm}\n")
    poses = manifests.read_poses(spark, str(tmp_path / "s1" / "poses.yaml"), ["8"]).collect()
    assert len(poses) == 1 and poses[0]["mask"] == "m.pbm" and len(poses[0]["h_mat"]) == 16 and poses[0]["depth_scaling"] == 1
    (tmp_path / "s1" / "list.txt").write_text("3\n\n12\n")
    assert {r["name"] for r in manifests.expand_frame_lists(spark, str(tmp_path / "s1" / "list.txt")).collect()} == {"s1_[3]", "s1_[12]"}
    (tmp_path / "split.yaml").write_text("- {name: a, folder: /x/, scene: s1, frames: [1, 2]}\n")
    assert manifests.read_sequences(spark, str(tmp_path / "split.yaml"), "train").first()["frames"] == [1, 2]


def test_obj_round_trip_with_labels(spark, tmp_path):
    v = spark.createDataFrame([("m", k, float(k), 0.5, -1.25) for k in range(4)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 3, 2, 1)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    labels = spark.createDataFrame([("m", 1, 0.5)], "mesh_id string, vid long, label double")
    lines = mesh_files.format_obj(v, f, labels).orderBy("part", "n").collect()
    (tmp_path / "m.obj").write_text("# c\n" + "\n".join(r["value"] for r in lines) + "\n")
    assert lines[1]["value"] == "v 1.0000 0.5000 -1.2500 0.5000 0.5000 0.5000"
    v2, f2 = mesh_files.read_obj(spark, str(tmp_path / "m.obj"))
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, f2.collect())) == sorted(map(tuple, f.collect()))


def test_tiles_keep_every_cell(spark):
    rows = [(1, i, j, k, float(i * 100 + j * 10 + k)) for i, j, k in itertools.product(range(5), range(3), range(7))]
    v = spark.createDataFrame(rows, "scene_id long, i int, j int, k int, v double")
    assert sorted(map(tuple, grid.unpack(grid.pack(v, 4), 4).collect())) == sorted(rows)


def test_ring_samples_match_numpy(spark):
    from voxelloom.operators import features

    g = one_grid(spark, (9, 8, 7), 0.21, (0.013, -0.4, 0.1), 0.37)
    v = grid.grid_cells(g).where("(i + j + k) % 5 <> 0").select("scene_id", "i", "j", "k", (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).cast("double").alias("v"))
    cells = {(r["i"], r["j"], r["k"]): r["v"] for r in v.collect()}
    points = [(1, n, 0.3 + 0.11 * n, 0.2 + 0.07 * n, 0.6, 0.5 - n / 3, 0.4) for n in range(5)]
    samples = spark.createDataFrame(points, "scene_id long, sample_id long, x double, y double, z double, nx double, ny double")
    got = {r["sample_id"]: r["samples"] for r in features.ring_samples(samples, g, v, 0.173, 3).collect()}
    c, s = np.cos(0.37), np.sin(0.37)
    rot = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    for _, n, x, y, z, nx, ny in points:
        want = []
        for ring in range(1, 4):
            for el in np.radians([-45, 0, 45]):
                for az in np.arctan2(nx, ny) + np.radians(np.arange(0, 360, 45)):
                    want.append(0.173 * ring * np.array([np.sin(az) * np.cos(el), np.cos(az) * np.cos(el), np.sin(el)]))
        want += [np.array([0, 0, sign * 0.173 * ring]) for ring in range(1, 4) for sign in (1, -1)]
        idx = [tuple(np.floor(((np.array([x, y, z]) + o - [0.013, -0.4, 0.1]) @ rot) / 0.21).astype(int)) for o in want]
        assert len(idx) == 78 and got[n] == [cells.get(i) for i in idx]


def test_candidate_distances():
    visible, near, far = np.array([-1.0, -0.5, 0.2, 0.9, 1.0]), np.array([-1.0, -0.5, 0.3, 1.0, 1.0]), np.array([1.0, 1, -1, -1, -1])
    for measure in ("just_empty", "narrow_band", "largest_of_free_zones"):
        assert dense.candidate_distance(measure, visible, near) < dense.candidate_distance(measure, visible, far)
    assert dense.candidate_distance("pointwise", visible, near, np.array([0, 2])) == 0.65


def test_unknown_is_null_never_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "id long, v double").select("id", S.known(F.col("v")).alias("v"))
    assert [r["v"] for r in df.orderBy("id").collect()] == [None, 0.5, None]
    raw = spark.createDataFrame([(0,), (3,)], "r long").select(S.decode_depth(F.col("r"), 2.0).alias("d"), S.decode_depth_tenth_mm(F.col("r")).alias("m"))
    assert [tuple(r) for r in raw.collect()] == [(None, None), (6 / 65536, 3e-4)]


def test_halves_snap_to_even_pixels(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.4999,), (1e300,), (None,)], "u double")
    assert [r[0] for r in df.select(G.snapped(F.col("u"))).collect()] == [0, 2, 0, 2, None, None]


def test_fusion_from_a_prior_and_in_a_band(spark):
    rows = [(1, 0, 0, 0, 1.0, 1.5), (1, 0, 0, 0, 1.0, 0.9), (1, 0, 0, 1, 3.0, 1.0)]
    seen = spark.createDataFrame(rows, "scene_id long, i int, j int, k int, z double, depth double")
    prior = spark.createDataFrame([(1, 0, 0, 0, 0.3), (1, 5, 5, 5, None)], "scene_id long, i int, j int, k int, v double")
    got = fusion.fuse(seen, 0.2, surface=0.15, prior=prior).collect()
    assert len(got) == 1 and abs(got[0]["v"] - (0.2 - 0.1 + 0.3) / 3) < 1e-12
    assert (got[0]["n_frames"], got[0]["visible_count"], got[0]["visible"]) == (2, 1, True)
    assert fusion.fuse(seen, 0.2, narrow_band=True).count() == 1


def test_nearest_searches_the_other_queries_too(spark):
    import __spark_entry__ as entry

    from voxelloom import testviews as V

    sf = "/root/testdata/sf0.01"
    rows = V.examples(spark, sf).collect()
    ids, x = np.array([r["example_id"] for r in rows]), np.array([r["x"] for r in rows])
    got = {r["query_id"]: r["dist"] for r in entry.queries()["j11_nearest"](spark, sf).collect()}
    assert set(got) == {n for n in ids.tolist() if n % 20 == 0}
    for n, dist in got.items():
        assert dist == pytest.approx(np.sqrt(((x[ids != n] - x[ids == n]) ** 2).sum(1).min()), abs=1e-5)
    same = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [9.0, 2.0])], "id long, x array<double>")
    for n in (1000, 1):
        found = learn.nearest(same.withColumnRenamed("id", "q"), same, "q", "id", "x", n, others=True)
        assert {r["q"]: (r["nn_id"], r["dist"]) for r in found.collect()} == {0: (20, 0.0), 20: (0, 0.0), 3: (0, 8.0)}
    assert learn.nearest(same.limit(1).withColumnRenamed("id", "q"), same.limit(1), "q", "id", "x", others=True).count() == 0


def test_every_event_is_a_sample(spark):
    from voxelloom import testviews as V

    sf = "/root/testdata/sf0.001"
    assert V.samples(spark, sf).count() == V.table(spark, sf, "events").count()


def test_cobweb_takes_every_masked_pixel(spark):
    import __spark_entry__ as entry

    from voxelloom import testviews as V

    sf = "/root/testdata/sf0.001"
    want = {(r["scene_id"], r["frame_id"], r["row"] * 32 + r["col"]) for r in V.pixels(spark, sf).where("mask").collect()}
    got = [tuple(r) for r in entry.queries()["v6_cobweb"](spark, sf).select("scene_id", "frame_id", "sample_id").collect()]
    assert set(got) == want and len(got) == len(want)


def test_example_store_gives_back_every_scene(spark):
    import __spark_entry__ as entry

    from voxelloom import testviews as V

    sf = "/root/testdata/sf0.001"
    want = sorted(r["example_id"] for r in V.examples(spark, sf).collect())
    assert sorted(r["example_id"] for r in entry.queries()["s8_example_store"](spark, sf).collect()) == want


def test_bags_hold_all_rows_of_their_scenes(spark):
    import __spark_entry__ as entry

    from voxelloom import testviews as V

    sf = "/root/testdata/sf0.1"
    scene = {r["example_id"]: r["scene_id"] for r in V.examples(spark, sf).select("example_id", "scene_id").collect()}
    bags = {}
    for r in entry.queries()["t4_bags"](spark, sf).collect():
        bags.setdefault(r["tree_id"], []).append(r["example_id"])
    assert set(bags) == {0, 1, 2, 3}
    for ids in bags.values():
        scenes = {scene[n] for n in ids}
        assert sorted(ids) == sorted(n for n, c in scene.items() if c in scenes) and len(ids) > 150


def test_mesh_files_hold_whole_meshes(spark):
    import __spark_entry__ as entry

    from voxelloom.plans.scene_queries import _mesh

    sf, q = "/root/testdata/sf0.01", entry.queries()
    v, f = (df.collect() for df in _mesh(spark, sf))
    known = {(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in v if r["x"] is not None}
    got = [(int(r["mesh_id"]), r["x"], r["y"], r["z"]) for r in q["s12_obj_files"](spark, sf).collect()]
    assert sorted(got) == sorted((m, *p) for (m, _), p in known.items()) and max(n for _, n in known) > 96
    faces = [[(r["mesh_id"], r[k]) for k in ("v0", "v1", "v2")] for r in f]
    want = sorted((t[0][0], *(known[p] for p in t)) for t in faces if all(p in known for p in t))
    lines = {(r["mesh_id"], r["part"], r["n"]): r["value"].split() for r in q["s13_ply_lines"](spark, sf).collect()}
    at = {(m, n): tuple(map(float, w)) for (m, part, n), w in lines.items() if part == 1}
    assert sorted((m, *(at[m, int(x)] for x in w[1:])) for (m, part, _), w in lines.items() if part == 2) == want
    assert len(want) < len(faces) and len(at) == len(known)


def test_holes_are_filled_from_the_nearest_pixel_in_row_major_order():
    rng = np.random.default_rng(4)
    for h, w, share in ((7, 9, 0.3), (12, 5, 0.9), (6, 6, 0.97), (3, 8, 1.0), (5, 5, 0.0)):
        x = np.where(rng.random((h, w)) < share, np.nan, rng.integers(1, 99, (h, w)).astype(float))
        known = np.argwhere(~np.isnan(x))
        want = x.copy() if len(known) else np.zeros_like(x)
        for r, c in np.argwhere(np.isnan(x)) if len(known) else []:
            want[r, c] = x[tuple(known[((known - (r, c)) ** 2).sum(1).argmin()])]
        assert (image.fill_holes(x) == want).all()


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 1.0, 0.0):
        mask = rng.random((13, 17)) < share
        want, n = np.zeros(mask.shape, int), 0
        for start in map(tuple, np.argwhere(mask)):
            if want[start]:
                continue
            n += 1
            stack = [start]
            while stack:
                r, c = stack.pop()
                if 0 <= r < 13 and 0 <= c < 17 and mask[r, c] and not want[r, c]:
                    want[r, c] = n
                    stack += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert (dense.label_components(mask) == want).all()


def test_nearest_along_an_axis():
    f = np.random.default_rng(6).random((4, 5, 6)) * 20
    for axis in range(3):
        n = f.shape[axis]
        moved = np.moveaxis(f, axis, -1)
        want = np.moveaxis(np.array([(moved + (np.arange(n) - p) ** 2).min(-1) for p in range(n)]), 0, -1)
        assert np.allclose(dense.nearest_along(f, axis), np.moveaxis(want, -1, axis))


def test_greedy_accept_equals_the_whole_iou(spark):
    rng = np.random.default_rng(8)
    cells = [(1, int(s), *map(int, rng.integers(0, 4, 3)), float(rng.integers(-8, 9)) / 8) for s in range(25) for _ in range(12)]
    truth = [(1, i, j, k, float(rng.integers(-8, 9)) / 8) for i, j, k in itertools.product(range(4), repeat=3) if rng.random() < 0.8]
    want, sums, best = [], {}, 0.0
    solid = {c[1:4] for c in truth if c[4] < 0}
    every = {c[1:4] for c in truth}
    for s in range(25):
        trial = dict(sums)
        for _, n, i, j, k, v in cells:
            if n == s:
                trial[i, j, k] = trial.get((i, j, k), 0.0) + v
        have = {c for c, v in trial.items() if v < 0 and c in every}
        iou = len(have & solid) / max(1, len(have | solid))
        if iou > best:
            best, sums = iou, trial
            want.append((s, iou))
    placed = spark.createDataFrame(cells, "scene_id long, sample_id long, i int, j int, k int, v double")
    known = spark.createDataFrame(truth, "scene_id long, i int, j int, k int, v double")
    got = sorted(tuple(r)[1:] for r in dense.greedy_accept(placed, known).collect())
    assert [s for s, _ in got] == [s for s, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert dense.greedy_accept(placed.where("scene_id = 2"), known).count() == 0


def test_blocks_of_scenes_without_cells_or_samples(spark):
    g = spark.createDataFrame([(n, 6, 5, 20, 0.25, floats(0, 0, 0), floats(1, 0, 0, 0, 1, 0, 0, 0, 1)) for n in (1, 2, 3)], GRID)
    v = spark.createDataFrame([(1, i, j, k, float(i + 10 * j + 100 * k) if i != 2 else None) for i, j, k in itertools.product(range(6), range(5), range(20))] + [(3, 0, 0, 0, 1.0)], "scene_id long, i int, j int, k int, v double")
    turn = floats(0, -1, 0, 1, 0, 0, 0, 0, 1)
    b = spark.createDataFrame([(1, 7, turn, floats(1.0, 0.25, 3.0)), (2, 8, turn, floats(1, 0, 0)), (1, 9, turn, floats(90, 0, 0)), (4, 10, turn, floats(1, 0, 0))], "scene_id long, sample_id long, rot array<double>, origin array<double>")
    want = []
    for a, c, e in itertools.product(range(3), range(2), range(6)):
        x, y, z = 1.0 - (c + 0.5) * 0.25, 0.25 + (a + 0.5) * 0.25, 3.0 + (e + 0.5) * 0.25
        i, j, k = int(x // 0.25), int(y // 0.25), int(z // 0.25)
        want.append(float(i + 10 * j + 100 * k) if k < 20 and i != 2 else None)
    for tile in (2, 16):
        got = {r["sample_id"]: r["vals"] for r in dense.cut_blocks(b, v, g, (3, 2, 6), 0.25, tile=tile).collect()}
        assert got == {7: want, 8: [None] * 36, 9: [None] * 36}
    assert dense.cut_blocks(b.where("sample_id < 0"), v, g, (3, 2, 6), 0.25).count() == 0


def test_cells_of_a_block_can_weigh_differently(spark):
    g = spark.createDataFrame([(1, 2, 2, 2, 1.0, floats(0, 0, 0), floats(1, 0, 0, 0, 1, 0, 0, 0, 1))], GRID)
    b = spark.createDataFrame([(1, floats(1, 0, 0, 0, 1, 0, 0, 0, 1), floats(0, 0, 0), [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0], [0.5, 0.0, 1.0, None, 1.0, 1.0, 2.0, 1.0])] * 2, "scene_id long, rot array<double>, origin array<double>, vals array<double>, w array<double>")
    got = {(r["i"], r["j"], r["k"]): (r["sum_v"], r["sum_w"], r["n"]) for r in dense.place_predictions(b, g, (2, 2, 2), 1.0).collect()}
    assert got[0, 0, 0] == (1.0, 1.0, 2) and got[0, 0, 1] == (0.0, 0.0, 2) and (0, 1, 0) not in got and got[0, 1, 1] == (0.0, 0.0, 2) and got[1, 1, 0] == (28.0, 4.0, 2)


def test_weights_are_resampled_beside_values(spark):
    g = one_grid(spark, angle=0.0)
    v = grid.grid_cells(g).select(*grid.CELL, (F.col("i") + F.col("k")).cast("double").alias("v"))
    w = v.where("i > 0").withColumn("v", F.col("i") / 2.0)
    got = grid.resample_upright(g, g, v, w)
    assert got.count() == 120 and got.where("w <> i / 2 OR n <> 1 OR v <> i + k").count() == 0
    summed = grid.accumulate(got)
    assert summed.where("sum_w <> i / 2 OR sum_v <> (i + k) * i / 2 OR n <> 1").count() == 0


def test_unknown_visible_cells_count_as_empty_of_evidence(spark):
    rows = [(1, 1, t, 100 + t, v, [None, 0.2, -0.1, None, 0.25]) for t, v in enumerate(([0.1] * 5, [-0.25, 0.2, -0.1, -0.25, 0.25]))]
    c = spark.createDataFrame(rows, "scene_id long, sample_id long, tree_id int, medoid_id long, vals array<double>, visible array<double>")
    for measure in ("just_empty", "narrow_band", "largest_of_free_zones"):
        r = dense.choose(c, "closest", measure).first()
        assert r["medoid_id"] == 101 and r["min_dist"] is not None
    nothing = c.withColumn("visible", F.transform("visible", lambda x: F.lit(None).cast("double")))
    assert dense.choose(nothing, "closest", "narrow_band").first()["min_dist"] is None


def test_scenes_of_a_group_stream_together(spark, tmp_path):
    """r1_fusion_stream called Python and its state once a scene: scenes of a group share both, and one that ends goes alone."""
    g = spark.range(1, 7).selectExpr("id AS scene_id", "CAST(5 + 13 * (id % 2) AS INT) AS ni", "4 AS nj", "3 AS nk", "0.25D AS vox_size", "array(0D, 0D, 0D) AS origin", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) AS rot")
    frames = g.selectExpr("scene_id", "explode(sequence(0, 2)) AS frame_id", "12 AS h", "16 AS w", "array(16D, 0D, 8D, 0D, 16D, 6D, 0D, 0D, 1D) AS k", "array(0D, 0D, 1D, -1D, 1D, 0D, 0D, 0.5D, 0D, 1D, 0D, 0.375D, 0D, 0D, 0D, 1D) AS h_mat")
    pixels = frames.selectExpr("scene_id", "frame_id", "explode(sequence(0, 11)) AS row").selectExpr("*", "explode(sequence(0, 15)) AS col").selectExpr("*", "(scene_id + frame_id + row + col) % 9 / 4D AS depth").where("col % 5 <> 1")
    prior = spark.createDataFrame([(2, 0, 0, 0, 0.5), (3, 17, 1, 1, 0.25)], "scene_id long, i int, j int, k int, v double")
    source, end = str(tmp_path / "in"), spark.createDataFrame([(3, 1, -1, 0, None)], pixels.schema)
    for part in (pixels.where("(row + scene_id) % 2 = 0"), end, pixels.where("(row + scene_id) % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(source)
        got = {tuple(r)[:4]: tuple(r)[4:] for r in streams.run_to_end(streams.fuse_stream(stream, g, frames, 0.25, prior, groups=2), str(tmp_path / "out")).collect()}
    seen = pixels.where("scene_id <> 3 OR (row + scene_id) % 2 = 0")
    want = {tuple(r)[:4]: (r["v"], r["sum_w"]) for r in fusion.fuse_grid(g, frames, seen, 0.25, prior=prior).where("n_frames > 0").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want) and len({c[0] for c in want}) == 6
