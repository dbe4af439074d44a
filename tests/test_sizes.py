"""What grows with the number of scenes: files, tasks' rows, and what a plan makes or broadcasts."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import yaml
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelloom.operators import dense, fusion, grid, image, learn, mesh, tiles
from voxelloom.sources import files, grids_io, manifests, rasters, reports

SF = "/root/testdata/sf0.001"


def scenes(spark, n):
    """`n` scenes of two cells each, dealt over three partitions without regard to the scene."""
    rows = spark.range(2 * n).select((F.col("id") % n).alias("scene_id"), (F.col("id") % 3).cast("int").alias("i"), F.lit(0).alias("j"), F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") / 4).alias("v"))
    return rows.repartition(3)


def test_centres_are_made_of_given_cells_only(spark):
    """j10_unseen_projection made, and broadcast, every cell of every grid."""
    g = spark.createDataFrame([(1, 2, 2, 2, 0.5, [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "scene_id long, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>")
    cells = spark.createDataFrame([(1, 0, 1, 1, 7.0), (1, 2, 0, 0, 8.0), (1, 0, -1, 0, 8.0), (2, 0, 0, 0, 9.0)], "scene_id long, i int, j int, k int, v double")
    assert [tuple(r) for r in grid.centres_of(cells, g).collect()] == [(1, 0, 1, 1, 7.0, 1.25, 2.75, 3.75)]
    plan = entry.queries()["j10_unseen_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Generate")
    assert len(plan) == 2  # frames only
    assert "Broadcast" not in plan[0].split("SortMergeJoin")[0]


def test_point_files_grow_with_folders_not_scenes(spark, tmp_path):
    points = scenes(spark, 600).select("scene_id", F.col("k").alias("event_id"), F.col("v").alias("x"), F.col("v").alias("y"))
    reports.write_points(points, str(tmp_path / "p"))
    assert 0 < len(list(Path(tmp_path, "p").rglob("*.csv"))) <= files.PARTS
    back = spark.read.csv(str(tmp_path / "p"), header=True, schema="scene_id long, event_id int, x double, y double").drop("part")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect()))


def test_grid_files_grow_with_folders_not_scenes(spark, tmp_path):
    voxels = scenes(spark, 600)
    grids_io.write_grids(voxels, str(tmp_path / "v"))
    assert 0 < len(list(Path(tmp_path, "v").rglob("*.parquet"))) <= files.PARTS
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(map(tuple, back.drop("part").collect())) == sorted(map(tuple, voxels.collect()))
    assert back.groupBy("scene_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_distance_of_sparse_cells_is_that_of_full_grids(spark):
    """v15_signed_distance made every cell a row and called Python once a plane: absent cells are empty, planes come together."""
    rng = np.random.default_rng(3)
    shapes, rows = {1: (5, 40, 4), 2: (3, 2, 6), 3: (5, 40, 4), 4: (2, 2, 2)}, []
    for scene, shape in shapes.items():
        rows += [(scene, *map(int, c), bool(rng.random() < 0.2)) for c in np.ndindex(shape)]
    schema = "scene_id long, i int, j int, k int, solid boolean"
    g = spark.createDataFrame([(n, *s) for n, s in shapes.items()] + [(5, 1, 2, 3)], "scene_id long, ni int, nj int, nk int")
    full = spark.createDataFrame(rows, schema)
    whole = sorted(map(tuple, dense.signed_distance(full, 0.5, 1.5).collect()), key=str)
    outside = spark.createDataFrame([(1, 5, 0, 0, True), (1, 0, 40, 0, True), (9, 0, 0, 0, True)], schema)
    sparse = dense.signed_distance(full.where("solid").unionByName(outside), 0.5, 1.5, g).collect()
    assert sorted((tuple(r) for r in sparse if r["scene_id"] != 5), key=str) == whole and len(whole) == len(rows)
    assert sum(r["scene_id"] == 5 and r["v"] is None for r in sparse) == 6


def test_frames_are_filtered_together(spark):
    """v1_bilateral_depth and v2_median_depth called Python once a frame: now frames of one size share a call, with the same pixels."""
    rng, rows = np.random.default_rng(4), []
    for n in range(60):
        h, w = ((6, 7), (9, 5), (1, 1))[n % 3]
        rows += [(n // 4, n % 4, r, c, None if (depth := float(rng.integers(0, 9))) < 2 or n == 12 else depth / 4) for r, c in np.ndindex(h, w) if (r, c) == (h - 1, w - 1) or rng.random() < 0.7]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double").repartition(2)
    filters = [(image.bilateral_depth, lambda x: image.bilateral(x, 30.0, 4.5)), (image.median_depth, lambda x: image.median_filter(x, 10))]
    for f, one in filters:
        want = {}
        for n in range(60):
            own = [r for r in rows if r[:2] == (n // 4, n % 4)]
            x = np.full((1 + max(r[2] for r in own), 1 + max(r[3] for r in own)), np.nan)
            for r in own:
                x[r[2], r[3]] = np.nan if r[4] is None else r[4]
            made = np.where(np.isnan(x), np.nan, one(image.fill_holes(x)))
            want |= {r[:4]: None if np.isnan(made[r[2], r[3]]) else float(made[r[2], r[3]]) for r in own}
        assert {tuple(r)[:4]: r["depth"] for r in f(pixels).collect()} == want
    some = np.where(rng.random((9, 8, 7)) < 0.5, np.nan, rng.random((9, 8, 7)))
    assert (image.fill_some(some) == np.stack([image.fill_holes(x) for x in some])).all()
    assert "FlatMapGroups" not in image.median_depth(pixels)._jdf.queryExecution().executedPlan().toString()


def test_rasters_are_listed_and_made_in_tasks(spark, tmp_path):
    """s3_depth_rasters called Python once a frame and had the driver list every file: images share calls, tasks list."""
    rng = np.random.default_rng(5)
    rows = [(s, f, r, c, int(rng.integers(0, 65536))) for s in range(30) for f in range(4) for r, c in np.ndindex(5, 6) if rng.random() < 0.3]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, raw long").repartition(3)
    coded = rasters.encode_rasters(pixels, ["scene_id", "frame_id"], "raw", 5, 6)
    assert files.write_files(coded, str(tmp_path)) == len({r[:2] for r in rows})
    Path(tmp_path, "7", "0.half.tmp").write_bytes(b"P5")
    found = rasters.read_rasters(spark, f"{tmp_path}/*/*", "raw")
    got = {(*map(int, r["file"].split("/")), r["row"], r["col"]): r["raw"] for r in found.collect()}
    assert len(got) == 30 * len({r[:2] for r in rows}) and {k: v for k, v in got.items() if v} == {r[:4]: r[4] for r in rows if r[4]}
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (coded, found)]
    assert "FlatMapGroups" not in plans[0] and "binaryFile" not in plans[1]


def test_pose_files_are_made_and_opened_in_tasks(spark, tmp_path):
    """s4_pose_files called Python once a scene and had the driver list every file."""
    rows = [(s, f, [float(s + f + n) / 8 for n in range(9)], [1e-7 * f + n for n in range(16)], 2.0) for s in range(40) for f in (2, 0, 10)]
    frames = spark.createDataFrame(rows, "scene_id long, frame_id int, k array<double>, h_mat array<double>, depth_scaling double").repartition(3)
    made = manifests.pose_files(frames, "d_")
    assert files.write_files(made, str(tmp_path)) == 40
    text = Path(tmp_path, "3", "poses.yaml").read_text()
    assert [x["id"] for x in yaml.safe_load(text)] == [0, 2, 10] and text == yaml.safe_dump(yaml.safe_load(text))
    found = manifests.read_poses(spark, f"{tmp_path}/*/poses.yaml")
    got = sorted((int(r["folder"]), int(r["frame_id"]), r["k"], r["h_mat"], r["depth_scaling"]) for r in found.collect())
    assert got == sorted(rows)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (made, found)]
    assert "FlatMapGroups" not in plans[0] and "FileScan text" not in plans[1]


def test_equal_vectors_are_searched_once_and_travel_by_shelves(spark, monkeypatch):
    """v13_nn_oracle and v13_coded_nn_oracle sent each query with its vector to every cell that no bound ruled out."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, (150, 20)) * 0.5
    data = base[rng.integers(0, 150, 2400)]
    data[data == 0] *= np.where(rng.random((data == 0).sum()) < 0.5, -1.0, 1.0)  # -0 is 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "id long, x array<double>")
    q, t = df.where("id % 2 = 1").withColumnRenamed("id", "q"), df.where("id % 2 = 0 AND id > 40")
    sent, plain = [], learn._meet

    def meet(asked, training, *args):
        sent.append((asked.count(), training.count(), asked.select("shelf").distinct().count()))
        return plain(asked, training, *args)

    monkeypatch.setattr(learn, "_meet", meet)
    got = {r["q"]: (r["nn_id"], r["dist"]) for r in learn.nearest(q, t, "q", "id", "x", 40, rows_a_pivot=4).collect()}
    d = ((data[1::2, None, :] - data[None, 42::2, :]) ** 2).sum(2)
    assert got == {2 * n + 1: (42 + 2 * int(row.argmin()), float(np.sqrt(row.min()))) for n, row in enumerate(d)}
    assert sent[1][1] <= 150 and sent[0][0] <= 150 and sent[1][0] <= 150 * sent[1][2] and sent[1][2] <= 8


def test_codes_of_equal_vectors_are_equal(spark):
    """Codes by a matrix product differ in their last bits with the place in a batch, so that copies aren't found again."""
    rng = np.random.default_rng(7)
    one, mean, parts = rng.standard_normal(37), rng.standard_normal(37), rng.standard_normal((5, 37))
    df = spark.createDataFrame([(k, one.tolist() if k % 3 else rng.standard_normal(37).tolist()) for k in range(300)], "id long, x array<double>")
    for n in (1, 3, 7):
        codes = learn.pca_transform(df.repartition(n), "x", "c", mean, parts).where("id % 3 <> 0").select("c").distinct().collect()
        assert len(codes) == 1 and np.allclose(codes[0]["c"], (one - mean) @ parts.T)


def test_images_are_made_in_tasks_not_pixel_rows(spark):
    """w1, w2, w7 and f4 joined every pixel of every frame and shuffled it for each window: given pixels go to their frame once."""
    rng, eye = np.random.default_rng(8), [8.0, 0.0, 3.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0]
    sizes = {(n // 4, n % 4): ((7, 9), (6, 1), (1, 1))[n % 3] for n in range(40)}
    frames = spark.createDataFrame([(*f, h, w, eye) for f, (h, w) in sizes.items()], "scene_id long, frame_id int, h int, w int, k array<double>")
    rows = [(*f, r, c, float(rng.integers(1, 9)) / 8, bool(rng.random() < 0.5)) for f, (h, w) in sizes.items() for r, c in np.ndindex(h, w) if rng.random() < 0.8]
    pixels = spark.createDataFrame([*rows, (0, 0, 7, 0, 1.0, True), (99, 0, 0, 0, 1.0, True)], "scene_id long, frame_id int, row int, col int, depth double, mask boolean").repartition(3)
    whole = image.dense(pixels, frames)
    z = image.gradient(image.gradient(whole.select(*image.PIXEL, F.col("depth").alias("z")), ["z"], "row"), ["z"], "col")
    z = image.gradient(image.gradient(z, ["z_row", "z_col"], "row"), ["z_col"], "col")
    want = {tuple(r)[:4]: (r["z_row_row"], r["z_col_col"]) for r in z.collect()}
    found = image.curvature(pixels, frames)
    assert {tuple(r)[:4]: (r["z_row_row"], r["z_col_col"]) for r in found.collect()} == want and len(want) == sum(h * w for h, w in sizes.values())
    every = {tuple(r)[:4]: tuple(r)[4:] for r in image.normals(pixels, frames).collect()}
    some = {tuple(r)[:5]: tuple(r)[5:] for r in image.normals(pixels, frames, kept=["mask"]).collect()}
    assert set(every) == set(want) and some == {(*r[:4], r[5]): every[r[:4]] for r in rows} and any(x[2] is not None for x in some.values())
    for name in ("w1_normals", "w2_curvature", "w7_jump_triangles", "f4_usable_pixels"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_frames_are_looked_up_together(spark, monkeypatch):
    """a1, a3, a8, f5 and j8 looked cells up a frame at a time, and a prior grid was grouped with all sums again."""
    g = spark.range(30).selectExpr("id AS scene_id", "5 AS ni", "4 AS nj", "3 AS nk", "0.25D AS vox_size", "array(0D, 0D, 0D) AS origin", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) AS rot")
    frames = g.selectExpr("scene_id", "explode(sequence(0, 2)) AS frame_id", "12 AS h", "16 AS w", "array(16D, 0D, 8D, 0D, 16D, 6D, 0D, 0D, 1D) AS k", "array(0D, 0D, 1D, -1D, 1D, 0D, 0D, 0.5D, 0D, 1D, 0D, 0.375D, 0D, 0D, 0D, 1D) AS h_mat")
    pixels = frames.selectExpr("scene_id", "frame_id", "explode(sequence(0, 11)) AS row").selectExpr("*", "explode(sequence(0, 15)) AS col").selectExpr("*", "(scene_id + frame_id + row + col) % 9 / 4D AS depth").where("col % 5 <> 1")
    prior = spark.createDataFrame([(2, 0, 0, 0, 0.5), (2, -1, 20, 0, 0.75), (3, 1, 1, 1, None), (99, 1, 2, 2, -0.5)], "scene_id long, i int, j int, k int, v double")
    for known in (None, prior):
        got = fusion.fuse_grid(g, frames, pixels, 0.25, prior=known)
        want = fusion.fuse(fusion.observe(grid.world_centres(g), frames, pixels), 0.25, prior=known)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    calls, plain = [], fusion._look_up
    monkeypatch.setattr(fusion, "_look_up", lambda views, *args: calls.append(len(views["rot"])) or plain(views, *args))
    bands = fusion.frame_bands(g, frames).toPandas()
    view = {c: bands[c].iloc[0] for c in ("ni", "nj", "nk", "h", "w", "band")} | {c: np.array(bands[c].tolist(), float).reshape(len(bands), *s) for c, s in (("vox_size", ()), ("rot", (3, 3)), ("origin", (3,)), ("intrinsics", (3, 3)), ("view", (3, 4)))}
    sums = fusion._Sums(16, pa.int64(), 0, lambda z, depth: (z > 0, []))
    fusion._look_up(view | {c: pa.array(bands[c]) for c in ("scene_id", "frame_id")}, np.zeros(3, int), np.ones((len(bands), 64, 16)), 16, 64, sums)
    assert calls == [90] and len(sums.sums.held) == 30


def test_tiles_of_frames_are_found_together():
    """a8 and f5 called Python once a frame to see which tiles its bands reach."""
    rng = np.random.default_rng(9)
    views = {"vox_size": np.full(40, 0.05), "rot": np.stack([np.eye(3)] * 40), "origin": rng.standard_normal((40, 3)), "intrinsics": np.stack([np.array([[200.0, 0, 32], [0, 200, 24], [0, 0, 1]])] * 40), "view": np.stack([np.hstack([np.linalg.qr(rng.standard_normal((3, 3)))[0], rng.standard_normal((3, 1))]) for _ in range(40)])}
    boxes, use, first, last = fusion._tiles_in(views, (20, 33, 17, 48, 64), 8, 16)
    for n in range(40):
        one = {c: x[n] for c, x in views.items()} | dict(zip(("ni", "nj", "nk", "h", "w"), (20, 33, 17, 48, 64), strict=True))
        for x, y in zip(fusion.tile_bands(one, 8, 16), (boxes, first[n], last[n]), strict=True):
            assert (x == y[use[n]]).all()
    assert 0 < use.sum() < use.size


def test_scenes_accept_together(spark):
    """v14_greedy_accept called Python once a scene: small scenes share a call, with the same samples as one by one."""
    rng = np.random.default_rng(10)
    cells = [(n, f"s{rng.integers(0, 14):02d}", *map(int, rng.integers(-1, 3, 3)), float(rng.integers(-8, 9)) / 8) for n in range(40) for _ in range(n * 3)]
    truth = [(n, *map(int, c), None if rng.random() < 0.1 else float(rng.integers(-8, 9)) / 8) for n in range(1, 43) if n % 7 for c in np.ndindex(3, 3, 3)]
    want = {}
    for n in range(40):
        solid, known, sums, best = {t[1:4] for t in truth if t[0] == n and (t[4] or 0) < 0}, {t[1:4] for t in truth if t[0] == n and t[4] is not None}, {}, 0.0
        for name in sorted({c[1] for c in cells if c[0] == n}):
            trial = dict(sums)
            for c in cells:
                if c[:2] == (n, name):
                    trial[c[2:5]] = trial.get(c[2:5], 0.0) + c[5]
            have = {c for c, v in trial.items() if v < 0} & known
            iou = len(have & solid) / max(1, len(have | solid))
            if iou > best:
                best, sums, want[n, name] = iou, trial, iou
    placed = spark.createDataFrame(cells, "scene_id long, sample_id string, i int, j int, k int, v double").repartition(3)
    found = dense.greedy_accept(placed, spark.createDataFrame(truth, "scene_id long, i int, j int, k int, v double"))
    assert {(r["scene_id"], r["sample_id"]): r["iou"] for r in found.collect()} == want and len(want) > 60
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_cubes_are_made_in_tiles_not_cell_rows(spark):
    """v16_iso_surface sent each cell to eight cubes and grouped those: a task's memory was that of eight times the cells."""
    rng = np.random.default_rng(11)
    some = {(n, *map(int, np.array(c) - 4)): float(rng.integers(-4, 9)) / 8 for n in range(5) for c in np.ndindex(9, 6, 8) if rng.random() < 0.9}
    voxels = spark.createDataFrame([(*c, v) for c, v in some.items()] + [(9, 0, 0, 0, None)], "scene_id long, i int, j int, k int, v double").repartition(3)
    want = set()
    for n, i, j, k in {(c[0], *(x - d for x, d in zip(c[1:], s, strict=True))) for c in some for s in np.ndindex(2, 2, 2)}:
        near = [some.get((n, i + a, j + b, k + c)) for a, b, c in np.ndindex(2, 2, 2)]
        if None not in near and min(near) < 0.25 <= max(near):
            want.add((n, i, j, k, *(v - 0.25 for v in near)))
    for tile in (3, 16):
        got = [tuple(r) for r in mesh.crossed_cubes(voxels, 0.25, tile).collect()]
        assert set(got) == want and len(got) == len(want) > 50
    plan = mesh.iso_triangles(voxels, spark.createDataFrame([], "scene_id long, vox_size double, rot array<double>, origin array<double>"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Broadcast" not in plan


def test_small_dumps_are_written_once_and_described_in_tasks(spark, tmp_path, monkeypatch):
    """s1_s2_grid_dumps made a folder of slabs for each scene and copied it, and the driver read every description."""
    g = spark.range(50).selectExpr("id AS scene_id", "3 AS ni", "2 AS nj", "id % 4 AS nk", "0.5D AS vox_size", "array(0D, 0D, 1D) AS origin", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) AS rot").withColumn("nk", F.col("nk").cast("int"))
    voxels = scenes(spark, 50)
    assert grids_io.write_dumps(voxels, g, str(tmp_path / "d"), 12) == 50
    assert len(list(Path(tmp_path, "d").rglob("*"))) == 150 and not list(Path(tmp_path, "d").rglob("*slabs*"))
    reader = grids_io.DumpReader({"path": str(tmp_path / "d"), "slab_cells": "100"})
    monkeypatch.setattr(grids_io, "parsed_meta", None)  # the driver reads no description
    parts = reader.partitions()
    monkeypatch.undo()
    assert sum(n for p in parts for *_, n in p.ranges) == 6 * sum(n % 4 for n in range(50)) and all(sum(r[3] for r in p.ranges) <= 100 for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6 * sum(n % 4 for n in range(50))
    back = grids_io.read_dumps(spark, str(tmp_path / "d"), unknown="false").select("scene_id", "i", "j", "k", "v")
    want = voxels.where("j < 2 AND k < scene_id % 4").select(F.col("scene_id").cast("string"), "i", "j", "k", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_grids_of_one_tile_are_not_joined_from_parts(spark):
    """v12_reconstruction and v13_pca_oracle called Python once a tile, shuffled a block's one part again and filled it by interpreted expressions."""
    rng, turn = np.random.default_rng(5), [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    g = spark.createDataFrame([(s, 4, 5, 6, 0.5, [0.0, 0.0, 0.0], turn) for s in range(3)], "scene_id long, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>")
    v = spark.createDataFrame([(s, *map(int, c), float(rng.integers(-8, 8))) for s in (0, 1) for c in np.ndindex(4, 5, 6) if rng.random() < 0.7], "scene_id long, i int, j int, k int, v double")
    places = rng.integers(-3, 6, (60, 3)) / 2
    b = spark.createDataFrame([(n % 3, n, turn, p.tolist()) for n, p in enumerate(places)], "scene_id long, sample_id long, rot array<double>, origin array<double>")
    cut = lambda tile: dense.cut_blocks(b, v, g, (2, 3, 2), 0.5, tile=tile, fill=9.0, masked=True)
    assert "collect_list" not in cut(8)._jdf.queryExecution().toString()
    alone, joined = ({r["sample_id"]: (r["vals"], r["mask"]) for r in cut(tile).collect()} for tile in (8, 2))
    assert len(alone) == 60 and alone == joined
    cells = {(r["scene_id"], r["i"], r["j"], r["k"]): r["v"] for r in v.collect()}
    for n, p in enumerate((places * 2).astype(int)):
        want = [cells.get((n % 3, *(p + c).tolist())) for c in np.ndindex(2, 3, 2)]
        assert alone[n] == ([9.0 if x is None else x for x in want], [float(x is None) for x in want])


def test_rows_meet_in_single_precision_and_boxes_skip_cells(spark, monkeypatch):
    """v13_coded_nn_oracle asked most cells by pivots' bounds; both searches made and looked at doubles of every pair several times."""
    rng = np.random.default_rng(12)
    data = rng.standard_normal((6000, 8)) + 1e4  # far from 0, where single precision alone would not tell rows apart
    data[4001] = data[17]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "id long, x array<double>")
    _, cells = learn.voronoi(df.where("id < 4000"), "id", "x", rows_a_pivot=16)
    d = ((data[4000:, None, :] - data[None, :4000, :]) ** 2).sum(2)
    near = cells.near(data[4000:], np.sqrt(d.min(1)))
    home = cells.home(data[:4000])
    assert (cells.count == np.bincount(home, minlength=len(cells.count))).all() and len(cells.count) == 250
    assert near[np.arange(2000), home[d.argmin(1)]].all() and near.mean() < 0.35
    exact = []
    plain = learn._Search.meet
    monkeypatch.setattr(learn._Search, "meet", lambda s, rows, ids, x, flat: exact.append(flat.dtype) or plain(s, rows, ids, x, flat))
    everything = learn._Shelf([(home, np.arange(4000), data[:4000])])
    for asks in (near, np.ones_like(near)):  # cell by cell, and whole
        found = everything.search(cells, data[4000:], np.full(2000, np.inf), asks, 0, None, False)
        assert (found.ids == d.argmin(1)).all() and (found.square == d.min(1)).all()
    assert set(exact) == {np.dtype(np.float32)} and found.ids[1] == 17
    huge = learn._Shelf([(home, np.arange(4000), data[:4000] * 1e20)])
    assert (huge.search(cells, data[4000:] * 1e20, np.full(2000, np.inf), np.ones_like(near), 0, None, False).ids == d.argmin(1)).all() and np.dtype(np.float64) in exact


def test_blocks_are_cut_from_packed_tiles(spark):
    """v12_reconstruction shuffled and sorted every cell of the visible grid four times and of the true one twice."""
    rng, turn = np.random.default_rng(13), [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    g = spark.createDataFrame([(f"s{s}", 9, 5, 6, 0.5, [0.0, 0.0, 0.0], turn) for s in range(4)], "scene_id string, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>")
    rows = [(f"s{s}", *map(int, c), None if rng.random() < 0.1 else float(rng.integers(-8, 8))) for s in (0, 1, 3) for c in np.ndindex(9, 5, 6) if rng.random() < 0.7]
    v = spark.createDataFrame(rows, "scene_id string, i int, j int, k int, v double").repartition(3)
    b = spark.createDataFrame([(f"s{n % 4}", n, turn, (rng.integers(-3, 12, 3) / 2).tolist()) for n in range(80)], "scene_id string, sample_id long, rot array<double>, origin array<double>")
    labels = v.selectExpr("scene_id", "i", "j", "k", "i % 3 AS label")
    for tile in (4, 16):
        held = tiles.packed(v, tile)
        assert sum(len(r["cells"]) // 4 for r in held.collect()) == sum(r[4] is not None for r in rows)
        whole = held.repartition(1).count()
        assert whole <= 3 * 3 * (18 if tile == 4 else 1)  # a row a tile and batch
        for more in ({}, {"labels": labels}):
            blocks = b.selectExpr("*", "sample_id % 3 AS label") if more else b
            got, want = (sorted(map(str, dense.cut_blocks(blocks, x, g, (2, 3, 2), 0.5, tile=tile, fill=9.0, masked=True, **more).collect())) for x in (held, v))
            assert got == want and len(got) == 80
