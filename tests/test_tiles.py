"""Tiles, bands, codes, pivots and slabs against plain loops."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelloom.operators import dense, fusion, grid, learn, sampling, tiles
from voxelloom.plans import reconstruct
from voxelloom.sources import grids_io

GRID = "scene_id long, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>"
FRAMES = "scene_id long, frame_id int, h int, w int, k array<double>, h_mat array<double>"
VOXELS = "scene_id long, i int, j int, k int, v double"


def floats(*x):
    return [float(v) for v in x]


FLAT = floats(1, 0, 0, 0, 1, 0, 0, 0, 1)


def turned(angle):
    c, s = np.cos(angle), np.sin(angle)
    return [float(x) for x in (c, -s, 0, s, c, 0, 0, 0, 1)]


def views(spark, seed, n_frames=9, h=20, w=30):
    """Cameras all around and inside a turned grid, some looking away, with pixels that are known in part."""
    rng = np.random.default_rng(seed)
    g = spark.createDataFrame([(1, 11, 9, 7, 0.2, [0.3, -0.4, 0.1], turned(0.4)), (2, 5, 5, 5, 0.3, [0.0, 0.0, 0.0], turned(0.0))], GRID)
    frames, pixels = [], []
    for scene, f in itertools.product((1, 2), range(n_frames)):
        pose = np.eye(4)
        pose[:3, :3] = np.linalg.qr(rng.standard_normal((3, 3)))[0]
        pose[:3, 3] = rng.standard_normal(3) * (0.5 if f % 3 == 0 else 2.0)
        frames.append((scene, f, h, w, floats(25, 0, 14.2, 0, 25, 9.6, 0, 0, 1), pose.ravel().tolist()))
        pixels += [(scene, f, r, c, float(rng.uniform(0.5, 3)) if rng.random() < 0.8 else None) for r in range(h) for c in range(w)]
    pixels.append((1, 0, 99, 3, 1.0))  # outside the image
    pixels.append((7, 0, 3, 3, 1.0))  # of no grid
    return g, spark.createDataFrame(frames, FRAMES), spark.createDataFrame(pixels, "scene_id long, frame_id int, row int, col int, depth double")


@pytest.mark.parametrize(("tile", "band_rows"), [(16, 64), (4, 7), (2, 3)])
def test_tiles_see_what_points_see(spark, tile, band_rows):
    g, frames, pixels = views(spark, tile)
    names = [*grid.CELL, "frame_id", "col", "row"]
    want = {tuple(r[c] for c in names): (r["z"], r["depth"]) for r in fusion.observe(grid.world_centres(g), frames, pixels).collect()}
    rows = fusion.observe_grid(g, frames, pixels, tile, band_rows).collect()
    got = {tuple(r[c] for c in names): (r["z"], r["depth"]) for r in rows if r["depth"] is not None}
    assert len(rows) == fusion.project_voxels(grid.world_centres(g), frames).count() and got.keys() == want.keys() and len(got) > 100
    assert all(np.allclose(got[c], want[c]) for c in want)
    for options in ({}, {"narrow_band": True}, {"surface": 0.1}):
        a = {(r["scene_id"], r["i"], r["j"], r["k"]): tuple(r)[4:] for r in fusion.fuse_grid(g, frames, pixels, 0.2, tile=tile, band_rows=band_rows, **options).collect()}
        b = {(r["scene_id"], r["i"], r["j"], r["k"]): tuple(r)[4:] for r in fusion.fuse(fusion.observe(grid.world_centres(g), frames, pixels), 0.2, **options).collect()}
        assert a.keys() == b.keys() and all(np.allclose(np.array(a[c], float), np.array(b[c], float)) for c in b)


def test_most_tiles_of_a_narrow_view_are_culled():
    """Of 512 tiles of a large grid a telephoto camera sees few, and every cell that falls in its image is in one of them."""
    pose = np.eye(4)
    pose[:3, 3] = (0.0, 0.0, -3.0)
    view = {"ni": 64, "nj": 64, "nk": 64, "vox_size": 0.05, "rot": np.eye(3), "origin": np.array([-1.6, -1.6, 0.0]), "h": 48, "w": 64, "intrinsics": np.array([[200.0, 0, 32], [0, 200, 24], [0, 0, 1]]), "view": np.linalg.inv(pose)[:3]}
    boxes, first, last = fusion.tile_bands(view, 8, 16)
    culled = 1 - len(boxes) / 512
    idx = np.stack(np.meshgrid(*[np.arange(64)] * 3, indexing="ij"), -1).reshape(-1, 3)
    fu, fv, fz = fusion._flat(view, idx).T
    u, v = np.rint(fu / fz), np.rint(fv / fz)
    seen = (fz != 0) & (u >= 0) & (u < 64) & (v >= 0) & (v < 48)
    kept = {tuple(b): (lo, hi) for b, lo, hi in zip(boxes.tolist(), first.tolist(), last.tolist(), strict=True)}
    bands = {(*(c // 8).tolist(), int(r) // 16) for c, r in zip(idx[seen], v[seen], strict=True)}
    assert culled > 0.65 and all(tuple(b[:3]) in kept and kept[tuple(b[:3])][0] <= b[3] <= kept[tuple(b[:3])][1] for b in bands)
    touched = len({b[:3] for b in bands})
    assert touched <= len(boxes) <= 2 * touched


def test_no_row_of_a_cell_and_frame_is_shuffled(spark):
    g, frames, pixels = views(spark, 1, 2)
    plan = fusion.fuse_grid(g, frames, pixels, 0.2)._jdf.queryExecution().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert exchanges and not any("row#" in x.split("hashpartitioning(")[1] or "i#" in x.split("hashpartitioning(")[1].replace("bi#", "").replace("scene_id#", "").replace("frame_id#", "") for x in exchanges)


def test_tile_sums_add_up():
    rng = np.random.default_rng(3)
    sums = tiles.TileSums(1, 4)
    want = np.zeros((2, 64))
    for _ in range(5):
        lin, v = rng.integers(0, 64, 30), rng.random(30)
        sums.add("s", (1, 2, 3), lin, [v])
        np.add.at(want[0], lin, 1)
        np.add.at(want[1], lin, v)
    import pyarrow as pa

    batch = sums.batch(pa.string())
    at = np.frombuffer(batch["lin"][0].as_py(), "<i4")
    assert np.allclose(np.frombuffer(batch["sums"][0].as_py()).reshape(2, -1), want[:, at]) and not sums.held and len(at) == (want[0] > 0).sum()


def blocks_of(spark, n, seed, shape, size):
    rng = np.random.default_rng(seed)
    rows = [(1, k, turned(a), rng.uniform(-0.5, 2.5, 3).tolist()) for k, a in enumerate(rng.uniform(0, 6, n))]
    return rows, spark.createDataFrame(rows, "scene_id long, sample_id long, rot array<double>, origin array<double>")


@pytest.mark.parametrize("tile", [3, 16])
def test_cut_by_label_and_in_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(dense, "SAMPLES_A_COPY", 4)
    shape, size, n = (3, 4, 5), 0.17, (9, 8, 10)
    rot, origin = np.array(turned(0.3)).reshape(3, 3), np.array([0.2, 0.1, -0.3])
    g = spark.createDataFrame([(1, *n, 0.25, origin.tolist(), rot.ravel().tolist())], GRID)
    rng = np.random.default_rng(4)
    vals = np.where(rng.random(n) < 0.8, rng.random(n), np.nan)
    labs = rng.integers(0, 3, n)
    at = list(itertools.product(*map(range, n)))
    v = spark.createDataFrame([(1, *c, float(vals[c]) if not np.isnan(vals[c]) else None) for c in at], VOXELS)
    labels = spark.createDataFrame([(1, *c, int(labs[c])) for c in at], "scene_id long, i int, j int, k int, label int")
    rows, b = blocks_of(spark, 15, 5, shape, size)
    b = b.withColumn("label", F.when(F.col("sample_id") % 4 < 3, F.col("sample_id") % 4))
    got = {r["sample_id"]: r["vals"] for r in dense.cut_blocks(b, v, g, shape, size, tile=tile, labels=labels).collect()}
    assert len(got) == 15 and sum(x is not None for r in got.values() for x in r) > 50
    for _, k, turn, o in rows:
        places = dense.cell_places(shape, size, np.array(turn).reshape(3, 3), np.array(o))
        idx = np.floor((places - origin) @ rot / 0.25).astype(int)
        wanted = k % 4 if k % 4 < 3 else 0
        for c, x in zip(map(tuple, idx), got[k], strict=True):
            inside = all(0 <= p < m for p, m in zip(c, n, strict=True)) and not np.isnan(vals[c]) and (wanted == 0 or labs[c] in (0, wanted))
            assert x == (vals[c] if inside else None)


@pytest.mark.parametrize("below", [None, 0.5])
def test_placed_blocks_equal_a_loop(spark, below):
    shape, size, n = (4, 3, 5), 0.3, (10, 9, 8)
    rot, origin = np.array(turned(-0.7)).reshape(3, 3), np.array([0.4, 1.5, -0.2])
    g = spark.createDataFrame([(1, *n, 0.25, origin.tolist(), rot.ravel().tolist())], GRID)
    rows, b = blocks_of(spark, 12, 6, shape, size)
    rng = np.random.default_rng(7)
    vals, w = rng.random((12, 60)), rng.random((12, 60))
    vals[rng.random((12, 60)) < 0.2] = np.nan
    data = [(k, [None if np.isnan(x) else float(x) for x in vals[k]], w[k].tolist()) for k in range(12)]
    p = b.join(spark.createDataFrame(data, "sample_id long, vals array<double>, w array<double>"), "sample_id")
    got = {(r["i"], r["j"], r["k"]): (r["sum_v"], r["sum_w"], r["n"]) for r in dense.place_predictions(p, g, shape, size, below, tile=4).collect()}
    want = {}
    for c in itertools.product(*map(range, n)):
        centre = rot @ ((np.array(c) + 0.5) * 0.25) + origin
        for _, k, turn, o in rows:
            a = np.floor((centre - o) @ np.array(turn).reshape(3, 3) / size).astype(int)
            if ((a >= 0) & (a < shape)).all():
                at = (a[0] * 3 + a[1]) * 5 + a[2]
                x = vals[k, at]
                if not np.isnan(x) and (below is None or x < below):
                    s = want.get(c, (0.0, 0.0, 0))
                    want[c] = (s[0] + x * w[k, at], s[1] + w[k, at], s[2] + 1)
    assert got.keys() == want.keys() and len(got) > 50 and all(np.allclose(got[c], want[c]) for c in want)


@pytest.mark.parametrize("how", ["closest", "medioid", "mean"])
def test_codes_are_chosen_as_their_blocks(spark, how):
    rng = np.random.default_rng(9)
    mean, parts, mask_mean, mask_parts = rng.random(12), rng.standard_normal((3, 12)), rng.random(12), rng.standard_normal((2, 12))
    codes, masks, seen = rng.standard_normal((8, 3)), rng.standard_normal((8, 2)), rng.standard_normal((5, 12))
    guess = [(1, s, t, int(rng.integers(0, 8))) for s in range(5) for t in range(3)]
    coded = spark.createDataFrame([(1, s, t, m, codes[m].tolist(), masks[m].tolist()) for _, s, t, m in guess], "scene_id long, sample_id long, tree_id int, medoid_id long, code array<double>, mask_code array<double>")
    whole = spark.createDataFrame([(1, s, t, m, (codes[m] @ parts + mean).tolist(), seen[s].tolist()) for _, s, t, m in guess], "scene_id long, sample_id long, tree_id int, medoid_id long, vals array<double>, visible array<double>")
    visible = spark.createDataFrame([(1, s, seen[s].tolist(), f"kept {s}") for s in range(5)], "scene_id long, sample_id long, visible array<double>, other string")
    decoder = None if how == "mean" else (mask_mean, mask_parts)
    got = {r["sample_id"]: r for r in dense.choose_among(visible, coded, how, "just_empty", 0.25, (mean, parts), decoder).collect()}
    want = {r["sample_id"]: r for r in dense.choose(whole, how, "just_empty").collect()}
    for s in range(5):
        assert got[s]["medoid_id"] == want[s]["medoid_id"] and got[s]["other"] == f"kept {s}" and np.allclose(got[s]["vals"], want[s]["vals"])
        assert how == "mean" or np.allclose(got[s]["mask"], masks[got[s]["medoid_id"]] @ mask_parts + mask_mean)


@pytest.mark.parametrize("others", [False, True])
def test_nearest_by_pivots_equals_brute_force_and_skips_cells(spark, others):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((12, 5)) * 20
    data = np.round(centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 5)), 1)
    data[5] = data[700]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "id long, x array<double>")
    q = df.where("id % 7 = 0").selectExpr("id AS q", "x")
    for max_rows, max_queries in ((20_000, 20_000), (17, 5)):
        got = {r["q"]: (r["nn_id"], r["dist"]) for r in learn.nearest(q, df, "q", "id", "x", max_rows, others, max_queries, rows_a_pivot=30).collect()}
        assert len(got) == len(range(0, 900, 7))
        for k, (nn, dist) in got.items():
            d = ((data - data[k]) ** 2).sum(1)
            if others:
                d[k] = np.inf
            assert nn == int(np.flatnonzero(d == d.min())[0]) and dist == pytest.approx(np.sqrt(d.min()))
    placed, cells = learn.voronoi(df, "id", "x", rows_a_pivot=30)
    assert placed.count() == 900 and cells.count.sum() == 900 and len(cells.pivots) > 20
    known = spark.createDataFrame([(k, data[k].tolist(), 1.0) for k in range(0, 900, 7)], "key long, x array<double>, known double")
    asked = learn.asked_cells(known, cells, False).collect()
    assert len(asked) < 0.4 * 129 * len(cells.pivots)  # most pairs of a query and a cell are skipped
    pairs = {(r["key"], r["cell"]) for r in asked}
    cell_of = {r["id"]: r["cell"] for r in placed.collect()}
    for k in range(0, 900, 7):  # and none that holds a row as near
        home = cells.bounds(data[k : k + 1])[0][0]
        near = np.flatnonzero(((data - data[k]) ** 2).sum(1) <= 1.0)
        assert all(cell_of[int(n)] == home or (k, cell_of[int(n)]) in pairs for n in near)


def test_dumps_go_and_come_by_slabs(spark, tmp_path):
    rng = np.random.default_rng(11)
    shapes = {"a": (5, 4, 7), "b": (1, 1, 1), "c": (3, 3, 3), "d": (6, 5, 4)}
    meta = spark.createDataFrame([(s, *n, 0.5, [0.0, 0.0, 1.0], FLAT) for s, n in shapes.items()], GRID.replace("scene_id long", "scene_id string"))
    cells = [(s, *c, float(np.float16(rng.random()))) for s, n in shapes.items() if s != "d" for c in itertools.product(*map(range, n)) if rng.random() < 0.7]
    v = spark.createDataFrame([*cells, ("a", 9, 0, 0, 1.0), ("a", 0, 0, 0, None)], VOXELS.replace("scene_id long", "scene_id string"))
    for slab in (7, 1 << 20):
        folder = str(tmp_path / f"s{slab}")
        assert grids_io.write_dumps(v, meta, folder, slab) == 4
        assert (tmp_path / f"s{slab}" / "d" / "grid.dat").stat().st_size == 240 and not (tmp_path / f"s{slab}" / "a" / "grid.dat.slabs").exists()
        back = grids_io.read_dumps(spark, folder, "truth", slab_cells=11)
        assert back.count() == 140 + 1 + 27 + 120 and back.rdd.getNumPartitions() == -(-288 // 11)
        assert sorted(tuple(r[c] for c in [*grid.CELL, "v"]) for r in back.where("v IS NOT NULL").collect()) == sorted(cells)
        assert grids_io.read_dumps(spark, folder, "truth", unknown="false").count() == len(cells)
        described = {r["scene_id"]: (r["ni"], r["nj"], r["nk"]) for r in grids_io.read_grid_meta(spark, f"{folder}/*/grid.yaml", "truth").collect()}
        assert described == shapes
    (tmp_path / "s7" / "a" / "grid.dat").write_bytes(b"\0" * 10)
    with pytest.raises(Exception, match="ends before"):
        grids_io.read_dumps(spark, str(tmp_path / "s7")).count()


def test_least_hashes_equal_a_sort(spark):
    rng = np.random.default_rng(12)
    rows = [(int(t), k, float(rng.integers(0, 40)) / 40) for t in range(3) for k in range(50 * (t + 1))]
    df = spark.createDataFrame(rows, "tree_id int, id long, h double")
    for cap, bins in ((30, 8), (70, 4096), (1000, 1), (60, 1)):
        got = sampling.least_hashes(df, ["tree_id"], F.col("h"), "id", cap, bins)
        want = sorted((t, k) for t in range(3) for _, k in sorted((h, k) for s, k, h in rows if s == t)[:cap])
        assert sorted((r["tree_id"], r["id"]) for r in got.collect()) == want and got.columns == df.columns


def test_envelope_is_exact_and_linear():
    rng = np.random.default_rng(13)
    for n in (1, 2, 9, 40):
        f = np.where(rng.random((30, n)) < 0.4, 1e12, rng.integers(0, 60, (30, n)).astype(float))
        p = np.arange(n)
        assert np.allclose(dense.nearest_along(f, 1), (f[:, None, :] + (p[None, :, None] - p[None, None, :]) ** 2).min(2))
    seconds = []
    for n in (500, 4000):  # the same number of places in longer lines
        f = np.where(rng.random((1_000_000 // n, n)) < 0.9, 1e12, 0.0)
        began = time.perf_counter()
        dense.nearest_along(f, 1)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 5 * seconds[0]  # eight times as many steps would be quadratic


def test_labels_grow_in_place(spark):
    rng = np.random.default_rng(14)
    offsets = [(r, c) for r in range(-3, 4) for c in range(-3, 4) if r * r + c * c <= 9]
    most = 0
    for share in (0.6, 0.75, 0.9):
        plan = rng.random((40, 31)) < share
        out = dense.label_components(np.logical_and.reduce([dense.shifted(plan, *s) for s in [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]]))
        for n in range(1, out.max() + 1):
            for r, c in np.argwhere(out == n):
                for a, b in offsets:
                    if 0 <= r + a < 40 and 0 <= c + b < 31:
                        out[r + a, c + b] = n
        assert (dense.segment_plan(plan, 3) == out).all()
        most = max(most, out.max())
    assert most > 3
    g = spark.createDataFrame([(1, 6, 5, 4, 1.0, [0.0] * 3, FLAT), (2, 9, 3, 4, 1.0, [0.0] * 3, FLAT)], GRID)
    v = grid.grid_cells(g).select(*grid.CELL, F.when(F.col("k") > 0, -1.0).otherwise(1.0).alias("v"))
    got = dense.segment(v, g, 1, 2, 1)
    assert got.count() == 120 + 108 and got.where("label = 1").groupBy("scene_id").count().count() == 2 and got.where("k = 0 AND label <> 0").count() == 0


@pytest.mark.parametrize("tile", [4, 16])
def test_neighbours_reach_over_tiles(spark, tile):
    rng = np.random.default_rng(15)
    shapes = {1: (9, 6, 11), 2: (3, 14, 5)}
    vals = {s: np.where(rng.random(n) < 0.9, rng.random(n), np.nan) for s, n in shapes.items()}
    g = spark.createDataFrame([(s, *n, 1.0, [0.0] * 3, FLAT) for s, n in shapes.items()], GRID)
    v = spark.createDataFrame([(s, *map(int, c), float(x[tuple(c)])) for s, x in vals.items() for c in np.argwhere(~np.isnan(x))], VOXELS)
    points = [(s, k, *map(int, rng.integers(-4, 16, 3))) for s in (1, 2, 3) for k in range(60)]
    offsets = [(3, 0, 0), (-3, 1, 2), (0, 0, 0)]
    got = tiles.neighbours(spark.createDataFrame(points, "scene_id long, id int, i int, j int, k int"), v, g, offsets, tile).collect()
    assert len(got) == 120
    for r in got:
        ends = np.array(shapes[r["scene_id"]]) - 1
        want = [vals[r["scene_id"]][tuple(np.clip(np.array([r["i"], r["j"], r["k"]]) + o, 0, ends))] for o in offsets]
        assert r["near"] == [None if np.isnan(x) else x for x in want]


def test_reconstruction_finds_the_blocks_it_has_learnt(spark):
    """Two kinds of surface, each with its own block and feature: the forest gives every new sample its kind's block, which is
    placed back whole, and ground and binary outputs follow."""
    shape, size = (2, 2, 4), 0.5
    g = spark.createDataFrame([(s, 8, 4, 4, size, [0.0] * 3, FLAT) for s in (1, 2)], GRID)
    kinds = np.stack([np.where(np.arange(16) % 4 < 2, -0.25, 0.25), np.where(np.arange(16) % 4 < 3, 0.25, -0.25)])
    rows = [(2, k, kinds[k % 2].tolist(), [0.0] * 16) for k in range(40)]
    own = spark.createDataFrame(rows, "scene_id long, sample_id long, vals array<double>, mask array<double>")
    model = reconstruct.Coded(own, "sample_id", 2)
    assert model.library.count() == 40 and len(model.vals[1]) == 2
    codes = model.library.select(F.lit(0).alias("tree_id"), F.col("medoid_id").alias("example_id"), F.array(F.when(F.col("medoid_id") % 2 == 0, 1.0).otherwise(-1.0)).alias("x"), F.col("code").alias("y"))
    nodes = learn.train_forest(codes.unionByName(codes.withColumn("tree_id", F.lit(1))), "m", tests=20, depth=3, pca_dims=2)
    places = [(1, 100 + k, FLAT, [float(2 * k) * size, 0.0, 0.0]) for k in range(4)]
    blocks = spark.createDataFrame(places, "scene_id long, sample_id long, rot array<double>, origin array<double>")
    x = blocks.select("scene_id", "sample_id", F.array(F.when(F.col("sample_id") % 2 == 0, 0.9).otherwise(-0.8)).alias("x"))
    seen = blocks.select("scene_id", "sample_id", F.array(*[F.lit(None).cast("double")] * 16).alias("vals"))
    chosen = reconstruct.predict_model(blocks, x, nodes, model, seen, "medioid", "narrow_band", 0.25)
    for r in chosen.collect():
        assert np.allclose(r["vals"], kinds[r["sample_id"] % 2]) and np.allclose(r["mask"], 0) and r["medoid_id"] % 2 == r["sample_id"] % 2
    placed = dense.place_predictions(reconstruct.weights(chosen), g, shape, size)
    visible = spark.createDataFrame([(1, 0, 0, 0, 0.125), (1, 7, 3, 3, None)], VOXELS)
    first = g.where("scene_id = 1")
    out = {(r["i"], r["j"], r["k"]): r for r in reconstruct.fill_in(placed, first, visible, 0.25, 1).collect()}
    assert len(out) == 128
    for i, j, k in itertools.product(range(8), range(2), range(4)):
        want = kinds[i // 2 % 2][k]
        assert out[i, j, k]["average"] == pytest.approx(want) and out[i, j, k]["n"] == 1
        assert out[i, j, k]["keeping_existing"] == pytest.approx(0.125 if (i, j, k) == (0, 0, 0) else want)
        assert out[i, j, k]["remove_excess"] == pytest.approx(0.25 if (i, j, k) == (0, 0, 0) else want)
    assert out[0, 3, 0]["average"] == 0.25 and out[7, 3, 3]["keeping_existing"] is None
    ground = {(r["i"], r["j"], r["k"]): r for r in reconstruct.fill_in(placed, first, visible, 0.25, 1, F.lit(2)).collect()}
    assert [ground[1, 0, k]["average"] for k in range(3)] == [-0.25, -0.25, 0.25] and ground[0, 0, 0]["keeping_existing"] == -0.25 and ground[3, 3, 1]["average"] == 0.25
    binary = {(r["i"], r["j"], r["k"]): r for r in reconstruct.fill_in(placed, first, visible, 0.25, 1, binary=True).collect()}
    assert binary[1, 0, 0]["average"] == pytest.approx(kinds[0][0] + 0.5) and binary[0, 3, 0]["average"] == 0.25


def test_coded_nearest_gives_blocks_and_weights_back(spark):
    rng = np.random.default_rng(16)
    vals, masks = rng.random((30, 6)), (rng.random((30, 6)) < 0.3).astype(float)
    own = spark.createDataFrame([(2, k, vals[k].tolist(), masks[k].tolist()) for k in range(30)], "scene_id long, sample_id long, vals array<double>, mask array<double>")
    truth = rng.random((7, 6))
    t = spark.createDataFrame([(1, k, truth[k].tolist(), FLAT) for k in range(7)], "scene_id long, sample_id long, vals array<double>, rot array<double>")
    for components in (6, 2):
        model = reconstruct.Coded(own, "sample_id", components)
        (mean, parts), (mask_mean, mask_parts) = model.vals, model.masks
        codes = (vals - mean) @ parts.T
        for r in reconstruct.coded_nn_oracle(t, model).collect():
            n = int((((truth[r["sample_id"]] - mean) @ parts.T - codes) ** 2).sum(1).argmin())
            assert np.allclose(r["vals"], codes[n] @ parts + mean) and r["rot"] == FLAT
            assert np.allclose(r["w"], 1 - (((masks[n] - mask_mean) @ mask_parts.T) @ mask_parts + mask_mean))


def test_pca_oracle_equals_numpy(spark):
    rng = np.random.default_rng(17)
    train, truth = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 8)), rng.standard_normal((4, 8))
    own = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(train)], "id long, vals array<double>")
    t = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(truth)], "scene_id long, sample_id long, vals array<double>")
    mean = train.mean(0)
    axes = np.linalg.svd(train - mean, full_matrices=False)[2][:3]
    for r in reconstruct.pca_oracle(t, own, 3).collect():
        assert np.allclose(r["vals"], (truth[r["sample_id"]] - mean) @ axes.T @ axes + mean, atol=1e-6) and r["w"] == [1.0] * 8


def test_pixel_normals_of_a_slope(spark):
    """Values that rise along one axis of a turned grid give that axis in the camera's frame at every pixel."""
    n = 12
    g = spark.createDataFrame([(1, n, n, n, 0.25, [-1.5, -1.5, 0.0], FLAT)], GRID)
    v = grid.grid_cells(g).select(*grid.CELL, (F.col("j") * 0.5).cast("double").alias("v"))
    pose = np.eye(4)
    pose[:3, :3] = np.array(turned(0.5)).reshape(3, 3)
    frames = spark.createDataFrame([(1, 0, 4, 4, floats(8, 0, 2, 0, 8, 2, 0, 0, 1), pose.ravel().tolist())], FRAMES)
    rows = [(1, 0, r, c, 1.5 if c else None, r < 3) for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(rows, "scene_id long, frame_id int, row int, col int, depth double, mask boolean")
    want = pose[:3, :3].T @ [0, 1, 0]
    for r in grid.pixel_normals(pixels, frames, v, g).collect():
        got = (r["nx"], r["ny"], r["nz"])
        assert got == (0, 0, 0) if r["row"] == 3 else got == (None, None, None) if r["col"] == 0 else np.allclose(got, want)
    assert grid.pixel_normals(pixels, frames, v.where("scene_id = 5"), g).where("row < 3 AND col > 0 AND nx IS NOT NULL").count() == 0
