"""Geometry, filters, joins and aggregations over the derived grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom import testviews as V
from voxelloom.functions import geometry as G
from voxelloom.functions import scalars as S
from voxelloom.operators import evaluate as E
from voxelloom.operators import fusion as U
from voxelloom.operators import grid as R
from voxelloom.plans.registry import query

CELL = R.CELL
W = V.with_views
MU = V.MU


def xyz(p, names=("x", "y", "z"), digits: int | None = None):
    return [(F.round(c, digits) if digits else c).alias(n) for c, n in zip(p, names, strict=True)]


@query("p1_idx_to_world", W("voxels") + " SELECT scene_id, i, j, k, (i + 0.5) / 16 AS x, (j + 0.5) / 16 AS y, (k + 0.5) / 16 AS z FROM voxels")
def p1(s, d):
    joined = V.voxels(s, d).join(V.grids(s, d), "scene_id")
    return joined.select(*CELL, *xyz(G.idx_to_world(G.columns("i", "j", "k"), F.col("vox_size"), F.col("rot"), F.col("origin"))))


@query("p2_world_to_idx", W("samples") + " SELECT event_id, scene_id, CAST(floor(y * 16) AS INTEGER) AS i, CAST(floor((0.5 - x) * 16) AS INTEGER) AS j, CAST(floor(z * 16) AS INTEGER) AS k, y < 0.5 AND x <= 0.5 AND x > -0.5 AND z < 0.75 AS inside FROM samples")
def p2(s, d):
    return R.locate(V.samples(s, d), V.grids(s, d, turned=True)).select("event_id", *CELL, "inside")


@query("p3_index_matrix", "SELECT s_suppkey AS scene_id, [0, -0.0625, 0, 0.5, 0.0625, 0, 0, 0, 0, 0, 0.0625, 0, 0, 0, 0, 1]::DOUBLE[] AS m FROM supplier")
def p3(s, d):
    m = G.idx_to_world_matrix(F.col("vox_size"), F.col("rot"), F.col("origin"))
    return V.grids(s, d, turned=True).select("scene_id", F.transform(m, lambda x: x + F.lit(0.0)).alias("m"))


@query("p4_meshgrid", W("cells") + " SELECT * FROM cells")
def p4(s, d):
    return R.world_centres(V.grids(s, d))


@query("p4_xy_meshgrid", W("cells") + " SELECT scene_id, i, j, x, y FROM cells WHERE k = 0")
def p4_xy(s, d):
    return R.column_centres(V.grids(s, d)).select("scene_id", "i", "j", "x", "y")


@query("p4_slice_heights", W("cells") + " SELECT DISTINCT scene_id, k, z FROM cells")
def p4_z(s, d):
    return R.slice_heights(V.grids(s, d))


@query("p5_corners", "SELECT s_suppkey AS scene_id, CAST(a * 8 AS INTEGER) AS i, CAST(b * 16 AS INTEGER) AS j, CAST(c * 12 AS INTEGER) AS k, CAST(0.5 - b * 1.0 AS DOUBLE) AS x, CAST(a * 0.5 AS DOUBLE) AS y, CAST(c * 0.75 AS DOUBLE) AS z FROM supplier, range(2) p(a), range(2) q(b), range(2) r(c)")
def p5(s, d):
    return R.corners(V.grids(s, d, turned=True)).select(*CELL, "x", "y", "z")


@query("p6_project_points", W("samples") + " SELECT event_id, CAST(f AS INTEGER) AS frame_id, round(32 * (y - 0.25) / (x + 0.5 + f / 8) + 16, 6) AS u, round(32 * (z - 0.375) / (x + 0.5 + f / 8) + 12, 6) AS v, x + 0.5 + f / 8 AS depth FROM samples, range(4) g(f)")
def p6(s, d):
    views = V.frames(s, d).select("scene_id", "frame_id", F.col("k").alias("intr"), G.inverse_pose(F.col("h_mat")).alias("view"))
    u, v, z = G.project(G.columns("x", "y", "z"), F.col("intr"), F.col("view"))
    return V.samples(s, d).join(views, "scene_id").select("event_id", "frame_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), z.alias("depth"))


def _points(s, d):
    """Camera and world points of all pixels."""
    p = V.pixels(s, d).join(V.frames(s, d), ["scene_id", "frame_id"])
    cam = G.unproject_camera(F.col("col"), F.col("row"), F.col("depth"), F.col("k"))
    return p.select("scene_id", "frame_id", "row", "col", "depth", "h_mat", *xyz(cam, ("cx", "cy", "cz"))).select("*", *xyz(G.camera_to_world(G.columns("cx", "cy", "cz"), F.col("h_mat"))))


@query("p7_unproject", W("pixels") + ' SELECT scene_id, frame_id, "row", col, depth - 0.5 - frame_id / 8 AS x, (col - 16) * depth / 32 + 0.25 AS y, ("row" - 12) * depth / 32 + 0.375 AS z FROM pixels')
def p7(s, d):
    return _points(s, d).select("scene_id", "frame_id", "row", "col", "x", "y", "z")


@query("p8_point_cloud", W("pixels") + ' SELECT scene_id, frame_id, col AS u, "row" AS v, depth AS d, (col - 16) * depth / 32 AS cx, ("row" - 12) * depth / 32 AS cy, depth AS cz FROM pixels')
def p8(s, d):
    return _points(s, d).select("scene_id", "frame_id", F.col("col").alias("u"), F.col("row").alias("v"), F.col("depth").alias("d"), "cx", "cy", "cz")


@query("p9_ray_image", W("pixels") + ' SELECT scene_id, frame_id, "row", col, round(sqrt(power((col - 16) * depth / 32, 2) + power(("row" - 12) * depth / 32, 2) + depth * depth) / 1000, 9) AS ray FROM pixels')
def p9(s, d):
    return _points(s, d).select("scene_id", "frame_id", "row", "col", F.round(G.ray_length(G.columns("cx", "cy", "cz")), 9).alias("ray"))


@query("p10_world_normals", W("samples") + " SELECT event_id, CAST(f AS INTEGER) AS frame_id, nz AS wx, nx AS wy, ny AS wz FROM samples, range(4) g(f)")
def p10(s, d):
    joined = V.samples(s, d).join(V.frames(s, d), "scene_id")
    return joined.select("event_id", "frame_id", *xyz(G.rotate_to_world(G.columns("nx", "ny", "nz"), F.col("h_mat")), ("wx", "wy", "wz")))


@query("p11_scaled_intrinsics", "SELECT s_suppkey AS scene_id, CAST(f AS INTEGER) AS frame_id, [16, 0, 8, 0, 16, 6, 0, 0, 1]::DOUBLE[] AS k FROM supplier, range(4) g(f)")
def p11(s, d):
    return V.frames(s, d).select("scene_id", "frame_id", G.scaled_intrinsics(F.col("k"), 0.5).alias("k"))


@query("p12_depth_decode", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 64 <> 0 THEN (l_partkey % 64) * 4.0 / 65536 END AS depth, CASE WHEN l_partkey % 64 <> 0 THEN (l_partkey % 64) / 10000 END AS depth_m FROM lineitem")
def p12(s, d):
    raw = F.col("l_partkey") % 64
    return V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.decode_depth(raw, 4.0).alias("depth"), S.decode_depth_tenth_mm(raw).alias("depth_m"))


@query("p13_unit_vectors", W("samples") + " SELECT event_id, round(nx / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 6) AS x, round(ny / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 6) AS y, round(nz / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 6) AS z FROM samples")
def p13(s, d):
    return V.samples(s, d).select("event_id", *xyz(G.unit(G.columns("nx", "ny", "nz")), digits=6))


@query("p14_homogeneous", W("samples") + " SELECT event_id, round((x + 2 * y + 1) / nullif(x + 0.5, 0), 6) AS x, round((y - z) / nullif(x + 0.5, 0), 6) AS y, round((3 * z + 0.25) / nullif(x + 0.5, 0), 6) AS z FROM samples")
def p14(s, d):
    m = V.doubles(1, 2, 0, 1, 0, 1, -1, 0, 0, 0, 3, 0.25, 1, 0, 0, 0.5)
    return V.samples(s, d).select("event_id", *xyz(G.mat4_apply(m, G.columns("x", "y", "z")), digits=6))


@query("p15_transform3", W("samples") + " SELECT event_id, x + 2 * y AS x, y - z AS y, 3 * z + x AS z FROM samples")
def p15(s, d):
    return V.samples(s, d).select("event_id", *xyz(G.mat3_apply(V.doubles(1, 2, 0, 0, 1, -1, 1, 0, 3), G.columns("x", "y", "z"))))


@query("p16_truncate", W("voxels") + " SELECT scene_id, i, j, k, greatest(least(v, 0.25), -0.25) AS v FROM voxels WHERE v IS NOT NULL")
def p16(s, d):
    return V.voxels(s, d).where("v IS NOT NULL").select(*CELL, G.truncate(F.col("v"), MU).alias("v"))


_FRAME = """, n AS (SELECT event_id, x, y, z, nx, ny, nullif(sqrt(nx * nx + ny * ny), 0) AS len FROM samples)
SELECT event_id, round(-ny / len, 6) AS xx, round(nx / len, 6) AS xy, round(-nx / len, 6) AS yx, round(-ny / len, 6) AS yy,
       round(x - (-ny / len * 0.5 + -nx / len * 0.5), 6) AS ox, round(y - (nx / len * 0.5 + -ny / len * 0.5), 6) AS oy, {z} AS oz FROM n WHERE len IS NOT NULL"""


def _block(s, d, tall):
    rot, origin = G.block_frame(G.columns("x", "y", "z"), G.columns("nx", "ny", "nz"), (4, 8, 4), 0.125, (1.0, 0.5, 0.5), tall, 0.375 if tall else None)
    df = V.samples(s, d).select("event_id", rot.alias("r"), origin.alias("o")).where("r IS NOT NULL")
    return df.select("event_id", *(F.round(F.col("r")[n], 6).alias(a) for a, n in (("xx", 0), ("xy", 3), ("yx", 1), ("yy", 4))), *(F.round(F.col("o")[n], 6).alias(a) for n, a in enumerate(("ox", "oy", "oz"))))


@query("p17_block_frame", W("samples") + _FRAME.format(z="round(z - 0.25, 6)"))
def p17(s, d):
    return _block(s, d, False)


@query("p17_tall_block_frame", W("samples") + _FRAME.format(z="CAST(0 AS DOUBLE)"))
def p17_tall(s, d):
    return _block(s, d, True)


@query("p18_weights", W("voxels") + " SELECT scene_id, i, j, k, round(exp(-5 * abs(v)), 9) AS confidence, CAST(CASE WHEN v > 0 THEN 0.375 ELSE 0.75 END AS DOUBLE) AS weight FROM voxels WHERE v IS NOT NULL")
def p18(s, d):
    v = F.col("v")
    return V.voxels(s, d).where("v IS NOT NULL").select(*CELL, F.round(S.confidence(F.abs(v), 5.0), 9).alias("confidence"), S.mask_weight(F.lit(0.25), v).alias("weight"))


_ROWS = ", r AS (SELECT scene_id, i, j, list(v ORDER BY k) AS vals FROM voxels GROUP BY 1, 2, 3)"


def _rows(s, d):
    """Values of each column of cells from the bottom, unknown ones NULL."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "v")))
    return V.voxels(s, d).groupBy("scene_id", "i", "j").agg(F.transform(ordered, lambda x: x.v).alias("vals"))


@query("p19_fill_features", W("voxels") + _ROWS + " SELECT scene_id, i, j, list_transform(vals, lambda x: coalesce(x, -5.0)) AS vals FROM r")
def p19(s, d):
    return _rows(s, d).withColumn("vals", S.fill_array(F.col("vals"), -5.0))


@query("p20_mask_trick", W("voxels") + " SELECT scene_id, i, j, k, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS m, coalesce(v, 0.25) AS fit_v, coalesce(v, max(v) OVER (PARTITION BY scene_id)) AS transform_v FROM voxels")
def p20(s, d):
    v = F.col("v")
    return V.voxels(s, d).select(*CELL, v.isNull().cast("int").alias("m"), F.coalesce(v, F.lit(MU)).alias("fit_v"), S.fill_with_scene_max(v, "scene_id").alias("transform_v"))


@query("p21_binarise", W("voxels") + " SELECT scene_id, i, j, k, CAST(CASE WHEN v > 0 THEN 0.5 WHEN v IS NOT NULL THEN -0.5 END AS DOUBLE) AS v FROM voxels")
def p21(s, d):
    return V.voxels(s, d).select(*CELL, (S.binarised(F.col("v")) - 0.5).alias("v"))


@query("p22_ground_plane", W("voxels") + " SELECT scene_id, i, j, k, CASE WHEN k < 3 THEN -0.25 WHEN k = 3 THEN 0.25 ELSE v END AS v FROM voxels")
def p22(s, d):
    return V.voxels(s, d).select(*CELL, S.with_ground(F.col("v"), F.col("k"), F.lit(3), MU).alias("v"))


@query("p23_floor_height", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE 0 END AS height FROM nation")
def p23(s, d):
    folder = F.concat(F.col("n_name"), F.lit("_"), (F.col("n_nationkey") % 4).cast("string"), F.lit("/"))
    return V.table(s, d, "nation").select("n_nationkey", S.floor_height(folder).alias("height"))


@query("p24_decimate", W("voxels") + " SELECT scene_id, i, j, k, v FROM voxels WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0")
def p24(s, d):
    return V.voxels(s, d).where(S.in_decimation(2, *G.columns("i", "j", "k")))


@query("f1_in_bounds", W("voxels") + " SELECT * FROM voxels WHERE i < 12 AND j < 6 AND k < 10")
def f1(s, d):
    return V.voxels(s, d).where(G.in_bounds(G.columns("i", "j", "k"), [F.lit(n) for n in (12, 6, 10)]))


@query("f2_inside_image", W("seen") + " SELECT * FROM seen")
def f2(s, d):
    return U.project_voxels(R.world_centres(V.grids(s, d)), V.frames(s, d)).select(*CELL, "frame_id", "col", "row", "z")


@query("f3_masked_set", W("voxels") + " SELECT scene_id, i, j, k, CASE WHEN v < -0.5 THEN -0.5 ELSE v END AS v FROM voxels")
def f3(s, d):
    return R.set_where(V.voxels(s, d), F.col("v") < -0.5, F.lit(-0.5))


@query("j1_depth_lookup", W("observed") + " SELECT * FROM observed")
def j1(s, d):
    return U.observe_grid(V.grids(s, d), V.frames(s, d), V.pixels(s, d)).where("depth IS NOT NULL")


@query("j2_bounded_lookup", W("voxels", "samples") + " SELECT event_id, p.scene_id, p.i, p.j, p.k, v FROM (SELECT event_id, scene_id, CAST(floor(x * 16) AS INTEGER) AS i, CAST(floor(y * 16) AS INTEGER) AS j, CAST(floor(z * 16) AS INTEGER) AS k FROM samples) p LEFT JOIN voxels USING (scene_id, i, j, k)")
def j2(s, d):
    return R.lookup(R.locate(V.samples(s, d), V.grids(s, d)), V.voxels(s, d)).select("event_id", *CELL, "v")


@query("j3_valid_lookup", W("voxels", "samples") + " SELECT event_id, scene_id, i, j, k, v FROM (SELECT event_id, scene_id, CAST(floor(x * 16) AS INTEGER) AS i, CAST(floor(y * 16) AS INTEGER) AS j, CAST(floor(z * 16) AS INTEGER) AS k FROM samples) p JOIN voxels USING (scene_id, i, j, k)")
def j3(s, d):
    return R.lookup(R.locate(V.samples(s, d), V.grids(s, d)).where("inside"), V.voxels(s, d), only_hits=True).select("event_id", *CELL, "v")


@query("j4_update", W("voxels", "samples") + ", u AS (SELECT scene_id, CAST(floor(x * 16) AS INTEGER) AS i, CAST(floor(y * 16) AS INTEGER) AS j, CAST(floor(z * 16) AS INTEGER) AS k, max_by(nx, event_id) AS nv FROM samples GROUP BY 1, 2, 3, 4) SELECT scene_id, i, j, k, CASE WHEN nv IS NOT NULL THEN nv ELSE v END AS v FROM voxels LEFT JOIN u USING (scene_id, i, j, k)")
def j4(s, d):
    updates = R.locate(V.samples(s, d), V.grids(s, d)).select(*CELL, F.col("event_id").alias("seq"), F.col("nx").alias("value"))
    return R.update(V.voxels(s, d), updates)


# Cell (a, b, c) of the turned grid has its centre at x = 1/2 - (b + 1/2)/16, y = (a + 1/2)/16, in cell (7 - b, a, c).
_TURNED = ", t AS (SELECT scene_id, CAST(j AS INTEGER) AS i, CAST(7 - i AS INTEGER) AS j, k, v AS nv FROM voxels WHERE i <= 7 AND v IS NOT NULL)"
_BASE = ", base AS (SELECT scene_id, j AS i, i AS j, k, v FROM voxels)"


def _resampled(s, d, mode):
    base = V.voxels(s, d).select("scene_id", F.col("j").alias("i"), F.col("i").alias("j"), "k", "v")
    return R.resample(V.grids(s, d, turned=True), base, V.grids(s, d), V.voxels(s, d), mode)


@query("j5_resample_replace", W("voxels") + _TURNED + _BASE + " SELECT scene_id, i, j, k, coalesce(nv, v) AS v FROM base LEFT JOIN t USING (scene_id, i, j, k)")
def j5(s, d):
    return _resampled(s, d, "replace")


@query("j5_resample_sum", W("voxels") + _TURNED + _BASE + " SELECT scene_id, i, j, k, CASE WHEN nv IS NULL THEN v ELSE coalesce(v, 0) + nv END AS v FROM base LEFT JOIN t USING (scene_id, i, j, k)")
def j5_sum(s, d):
    return _resampled(s, d, "sum")


@query("j5_resample_accumulator", W("voxels") + _TURNED + _BASE + " SELECT scene_id, i, j, k, CASE WHEN nv IS NULL THEN v ELSE coalesce(v, 0) + nv END AS v, CASE WHEN nv IS NULL THEN 0 ELSE 1 END AS n FROM base LEFT JOIN t USING (scene_id, i, j, k)")
def j5_acc(s, d):
    return _resampled(s, d, "accumulator")


@query("j6_resample_upright", W("voxels") + _TURNED + " SELECT scene_id, i, j, k, nv AS v FROM t")
def j6(s, d):
    return R.resample_upright(V.grids(s, d, turned=True), V.grids(s, d), V.voxels(s, d))


@query("j7_label_pixels", W("pixels", "voxels") + ', p AS (SELECT scene_id, frame_id, "row", col, CAST(floor((depth - 0.5 - frame_id / 8) * 16) AS INTEGER) AS i, CAST(floor(((col - 16) * depth / 32 + 0.25) * 16) AS INTEGER) AS j, CAST(floor((("row" - 12) * depth / 32 + 0.375) * 16) AS INTEGER) AS k FROM pixels) SELECT scene_id, frame_id, "row", col, CASE WHEN p.i > 0 AND p.j > 0 AND p.k > 0 THEN v END AS label FROM p LEFT JOIN voxels USING (scene_id, i, j, k)')
def j7(s, d):
    at = R.locate(_points(s, d), V.grids(s, d))
    inner = (F.col("i") > 0) & (F.col("j") > 0) & (F.col("k") > 0)  # index 0 is left out, as in the published rule
    return R.lookup(at, V.voxels(s, d)).select("scene_id", "frame_id", "row", "col", F.when(inner, F.col("v")).alias("label"))


def _fused(s, d, **options):
    return U.fuse_grid(V.grids(s, d), V.frames(s, d), V.pixels(s, d), MU, surface=0.125, **options)


@query("j8_keep_existing", W("fused", "voxels") + " SELECT scene_id, i, j, k, coalesce(f.v, p.v) AS v FROM (SELECT scene_id, i, j, k, round(v, 9) AS v FROM fused) f FULL JOIN voxels p USING (scene_id, i, j, k)")
def j8(s, d):
    return R.keep_existing(_fused(s, d).withColumn("v", F.round("v", 9)), V.voxels(s, d))


@query("j9_remove_excess", W("fused", "voxels") + " SELECT p.scene_id, p.i, p.j, p.k, CASE WHEN f.v > 0 THEN 0.25 ELSE coalesce(p.v, 0.25) END AS v FROM voxels p LEFT JOIN fused f USING (scene_id, i, j, k)")
def j9(s, d):
    return R.remove_excess(V.voxels(s, d), _fused(s, d), MU)


@query("j10_unseen_projection", W("voxels") + ', top AS (SELECT scene_id, max(v) AS top FROM voxels GROUP BY 1) SELECT scene_id, i, j, k, CAST(f AS INTEGER) AS frame_id, CAST(trunc(32 * ((j + 0.5) / 16 - 0.25) / ((i + 0.5) / 16 + 0.5 + f / 8) + 16) AS INTEGER) AS col, CAST(trunc(32 * ((k + 0.5) / 16 - 0.375) / ((i + 0.5) / 16 + 0.5 + f / 8) + 12) AS INTEGER) AS "row", (i + 0.5) / 16 + 0.5 + f / 8 AS z FROM voxels JOIN top USING (scene_id), range(4) g(f) WHERE v IS NULL OR v <> top')
def j10(s, d):
    return U.unseen_projection(R.centres_of(V.voxels(s, d), V.grids(s, d)), V.frames(s, d))


@query("a1_tsdf_fusion", W("fused") + " SELECT scene_id, i, j, k, round(v, 9) AS v, n FROM fused")
def a1(s, d):
    return _fused(s, d).select(*CELL, F.round("v", 9).alias("v"), F.col("n_frames").alias("n"))


@query("a1_narrow_band", W("observed") + " SELECT scene_id, i, j, k, round(avg(depth - z), 9) AS v FROM observed WHERE abs(z - depth) <= 0.25 GROUP BY 1, 2, 3, 4")
def a1_narrow(s, d):
    return _fused(s, d, narrow_band=True).select(*CELL, F.round("v", 9).alias("v"))


@query("a2_visible", W("fused") + " SELECT scene_id, i, j, k, on_surface = 1 AS visible, visible_count FROM fused")
def a2(s, d):
    return _fused(s, d).select(*CELL, "visible", "visible_count")


@query("a2_frustum_count", W("seen") + " SELECT scene_id, i, j, k, count(*) AS in_frustum_count FROM seen GROUP BY 1, 2, 3, 4")
def a2_frustum(s, d):
    return U.frustum_counts(U.project_voxels(R.world_centres(V.grids(s, d)), V.frames(s, d)))


@query("a3_fusion_with_prior", W("fused", "voxels") + " SELECT scene_id, i, j, k, round((coalesce(f.v * f.n, 0) + coalesce(p.v, 0)) / (coalesce(f.n, 0) + CASE WHEN p.v IS NULL THEN 0 ELSE 1 END), 9) AS v FROM fused f FULL JOIN (SELECT * FROM voxels WHERE v IS NOT NULL) p USING (scene_id, i, j, k)")
def a3(s, d):
    return _fused(s, d, prior=V.voxels(s, d)).select(*CELL, F.round("v", 9).alias("v"))


@query("a4_carving", W("observed", "voxels") + ", e AS (SELECT scene_id, i, j, k, count(CASE WHEN depth > z THEN 1 END) AS n FROM observed GROUP BY 1, 2, 3, 4) SELECT scene_id, i, j, k, coalesce(v, 0) + coalesce(n, 0) AS v FROM voxels LEFT JOIN e USING (scene_id, i, j, k)")
def a4(s, d):
    return U.carve_grid(V.grids(s, d), V.frames(s, d), V.pixels(s, d), V.voxels(s, d))


def _predictions(s, d):
    """One predicted value and weight for each line item, many to a cell."""
    rows = V.table(s, d, "lineitem")
    return rows.select(F.col("l_suppkey").alias("scene_id"), (F.col("l_partkey") % 8).cast("int").alias("i"), F.col("l_linenumber").alias("j"), (F.col("l_orderkey") % 6).cast("int").alias("k"), ((F.col("l_quantity") - 25) / 32).alias("v"), ((F.col("l_partkey") % 5) / 4.0).alias("w"))


_PRED = "WITH pred AS (SELECT l_suppkey AS scene_id, CAST(l_partkey % 8 AS INTEGER) AS i, l_linenumber AS j, CAST(l_orderkey % 6 AS INTEGER) AS k, (l_quantity - 25) / 32 AS v, (l_partkey % 5) / 4 AS w FROM lineitem), acc AS (SELECT scene_id, i, j, k, sum(v * w) AS sum_v, sum(w) AS sum_w, count(*) AS n FROM pred GROUP BY 1, 2, 3, 4)"


@query("a5_accumulate", _PRED + " SELECT * FROM acc")
def a5(s, d):
    return R.accumulate(_predictions(s, d))


@query("a5_accumulate_solid", _PRED + " SELECT scene_id, i, j, k, sum(v * w) AS sum_v, sum(w) AS sum_w, count(*) AS n FROM pred WHERE v < 0.25 GROUP BY 1, 2, 3, 4")
def a5_solid(s, d):
    return R.accumulate(_predictions(s, d), below=F.col("v") < 0.25)


@query("a6_average", _PRED + " SELECT scene_id, i, j, k, round(sum_v / nullif(sum_w, 0), 9) AS v FROM acc")
def a6(s, d):
    return R.average(R.accumulate(_predictions(s, d))).select(*CELL, F.round("v", 9).alias("v"))


@query("a7_least_evidence", _PRED + " SELECT scene_id, i, j, k, round(CASE WHEN n < 3 THEN 0.25 ELSE sum_v / nullif(sum_w, 0) END, 9) AS v FROM acc")
def a7(s, d):
    return R.least_evidence(R.average(R.accumulate(_predictions(s, d))), 3, MU).select(*CELL, F.round("v", 9).alias("v"))


@query("f5_evaluation_region", W("seen", "fused", "cells") + " SELECT scene_id, i, j, k FROM (SELECT DISTINCT scene_id, i, j, k FROM seen WHERE k >= 6) s LEFT JOIN fused USING (scene_id, i, j, k) WHERE v IS NULL OR v < 0")
def f5(s, d):
    fused = U.fuse_in_frustum(V.grids(s, d), V.frames(s, d), V.pixels(s, d), MU)
    return U.region_of(fused).select(*CELL)


def fusion_scores(s, d):
    """Fused grids against the truth, over the evaluation region of each scene."""
    fused = U.fuse_in_frustum(V.grids(s, d), V.frames(s, d), V.pixels(s, d), MU)
    return E.confusion_within(U.region_of(fused), V.voxels(s, d), MU)


_A8 = """, region AS (SELECT scene_id, i, j, k, v AS p FROM (SELECT DISTINCT scene_id, i, j, k FROM seen WHERE k >= 6) s LEFT JOIN fused USING (scene_id, i, j, k) WHERE v IS NULL OR v < 0),
m AS (SELECT scene_id, coalesce(p, 0.25) < 0 AS p, coalesce(v, -0.25) < 0 AS t FROM region JOIN voxels USING (scene_id, i, j, k)),
c AS (SELECT scene_id, count(CASE WHEN p AND t THEN 1 END) AS tp, count(CASE WHEN p AND NOT t THEN 1 END) AS fp, count(CASE WHEN NOT p AND t THEN 1 END) AS fn, count(CASE WHEN NOT p AND NOT t THEN 1 END) AS tn FROM m GROUP BY 1)
SELECT *, tp / nullif(tp + fp + fn, 0) AS iou, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c"""


@query("a8_scores", W("seen", "fused", "voxels") + _A8)
def a8(s, d):
    return fusion_scores(s, d)


@query("a9_mean_scores", W("scores") + ' SELECT test, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(avg(iou), 9) END AS iou, CASE WHEN count(*) >= 5 THEN round(avg("precision"), 9) END AS "precision", CASE WHEN count(*) >= 5 THEN round(avg(recall), 9) END AS recall FROM scores GROUP BY 1')
def a9(s, d):
    return E.mean_scores(V.scores(s, d), 5).select("test", "n", *(F.round(c, 9).alias(c) for c in ("iou", "precision", "recall")))


@query("a10_occupied_columns", W("voxels") + " SELECT scene_id, i, j, count(CASE WHEN v < 0 THEN 1 END) AS n, count(CASE WHEN v < 0 THEN 1 END) > 2 AS occupied FROM voxels WHERE k >= 2 GROUP BY 1, 2, 3")
def a10(s, d):
    return R.occupied_above(V.voxels(s, d), 2, 2)


@query("a11_top_view", W("voxels") + " SELECT scene_id, i, j, round(avg(v), 9) AS mean_v FROM voxels GROUP BY 1, 2, 3")
def a11(s, d):
    return R.top_view(V.voxels(s, d)).withColumn("mean_v", F.round("mean_v", 9))


def _labels(s, d):
    return V.voxels(s, d).select(*CELL, F.when(F.col("v") < 0, (F.col("i") + F.col("j")) % 4).otherwise(0).alias("label"))


_LABELS = ", labels AS (SELECT scene_id, i, j, k, CASE WHEN v < 0 THEN (i + j) % 4 ELSE 0 END AS label FROM voxels)"


@query("a12_distinct_labels", W("voxels") + _LABELS + " SELECT DISTINCT scene_id, label FROM labels")
def a12(s, d):
    return R.distinct_labels(_labels(s, d))


@query("a13_usage_counts", "SELECT 'forest' || CAST(l_linenumber % 2 AS VARCHAR) AS model, l_partkey AS medoid_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a13(s, d):
    used = V.table(s, d, "lineitem").select(F.concat(F.lit("forest"), (F.col("l_linenumber") % 2).cast("string")).alias("model"), F.col("l_partkey").alias("medoid_id"))
    return E.usage_counts(used)


@query("a14_empty_fraction_histogram", W("examples") + " SELECT CAST(least(floor(len(list_filter(y, lambda e: e > 0)) / 32 * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM examples GROUP BY 1")
def a14(s, d):
    return E.histogram(V.examples(s, d).select(E.empty_fraction("y").alias("f")), "f", 100, 0.0, 1.0)


@query("a15_l2_histogram", W("examples") + ", l AS (SELECT example_id, sqrt(list_sum([power(x[n] - y[n], 2) for n in range(1, 33)])) AS l FROM examples), e AS (SELECT min(l) AS lo, max(l) AS hi FROM l) SELECT CAST(least(floor((l - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin, count(*) AS n FROM l, e GROUP BY 1")
def a15(s, d):
    return E.histogram(V.examples(s, d).select(E.l2_difference("x", "y").alias("l")), "l", 100)


@query("a19_occupancy", W("voxels") + ", c AS (SELECT scene_id, i, j, k FROM voxels WHERE v < 0), m AS (SELECT scene_id, max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk FROM c GROUP BY 1) SELECT * FROM c JOIN m USING (scene_id)")
def a19(s, d):
    return R.occupancy(V.voxels(s, d).where("v < 0"))


@query("v4_label_copies", W("voxels") + _LABELS + " SELECT CAST(idx AS INTEGER) AS idx, scene_id, i, j, k, CASE WHEN label = 0 OR label = idx THEN v END AS v FROM voxels JOIN labels USING (scene_id, i, j, k), range(1, 3) r(idx)")
def v4(s, d):
    wanted = V.grids(s, d).select("scene_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"))
    return R.label_copies(V.voxels(s, d), _labels(s, d), wanted)


@query("w3_flatten_down", W("voxels") + _LABELS + ", t AS (SELECT scene_id, label AS idx, i, j, max(k) AS top FROM labels WHERE label > 0 GROUP BY 1, 2, 3, 4) SELECT scene_id, idx, i, j, CAST(k AS INTEGER) AS k FROM t, range(12) r(k) WHERE k <= top")
def w3(s, d):
    return R.flattened_down(_labels(s, d))


@query("w4_rankings", W("scores") + " SELECT s.test, s.scene_id, s.iou, CAST(row_number() OVER (PARTITION BY s.test ORDER BY s.iou DESC, s.scene_id) AS INTEGER) AS rank, s.iou / nullif(b.iou, 0) AS ratio FROM scores s LEFT JOIN (SELECT scene_id, iou FROM scores WHERE test = 'test0') b ON s.scene_id = b.scene_id")
def w4(s, d):
    return E.rankings(V.scores(s, d), "test0")


@query("u2_collected_results", W("scores") + " SELECT test, scene_id, iou, \"precision\", recall FROM scores UNION ALL SELECT 'external', s.scene_id, iou, \"precision\", recall FROM (SELECT DISTINCT scene_id FROM scores) s LEFT JOIN (SELECT scene_id, iou, \"precision\", recall FROM scores WHERE test = 'test1' AND scene_id <> 2) e ON s.scene_id = e.scene_id")
def u2(s, d):
    own = V.scores(s, d)
    external = own.where("test = 'test1' AND scene_id <> 2").drop("test")
    return E.with_external(own, external, own.select("scene_id").distinct(), "external")


def _neighbour(axis: str, step: int, n: int) -> str:
    at = f"least(greatest(c.{axis} + {step}, 0), {n - 1})"
    on = " AND ".join(f"o.{x} = {at if x == axis else 'c.' + x}" for x in "ijk")
    return f"coalesce((SELECT v FROM voxels o WHERE o.scene_id = c.scene_id AND {on}), least)"


def _near(axis: str, step: int) -> str:
    """The value `step` cells along an axis from a pixel's cell, all indices clamped."""
    at = {x: f"least(greatest(c.{x}{f' + {step}' if x == axis else ''}, 0), {n - 1})" for x, n in zip("ijk", V.SHAPE, strict=True)}
    on = " AND ".join(f"o.{x} = {at[x]}" for x in "ijk")
    return f"coalesce((SELECT v FROM voxels o WHERE o.scene_id = c.scene_id AND {on}), least)"


_W6 = ", m AS (SELECT scene_id, min(v) AS least FROM voxels GROUP BY 1), d AS (SELECT c.scene_id, c.i, c.j, c.k, " + ", ".join(f"{_neighbour(a, 3, n)} - {_neighbour(a, -3, n)} AS {x}" for a, x, n in zip("ijk", "xyz", V.SHAPE, strict=True)) + " FROM voxels c JOIN m ON c.scene_id = m.scene_id), l AS (SELECT *, CASE WHEN x*x + y*y + z*z = 0 THEN 1e-4 ELSE sqrt(x*x + y*y + z*z) END AS len FROM d)"


@query("w6_voxel_normals", W("voxels") + _W6 + " SELECT scene_id, i, j, k, round(x / len, 6) + 0 AS nx, round(y / len, 6) + 0 AS ny, round(z / len, 6) + 0 AS nz FROM l")
def w6(s, d):
    n = R.voxel_normals(V.voxels(s, d), V.grids(s, d))
    return n.select(*CELL, *((F.round(c, 6) + 0).alias(c) for c in ("nx", "ny", "nz")))


_W6_PIXELS = ", m AS (SELECT scene_id, min(v) AS least FROM voxels GROUP BY 1), p AS (SELECT *, CAST(floor((depth - 0.5 - frame_id / 8) * 16) AS INTEGER) AS i, CAST(floor(((col - 16) * depth / 32 + 0.25) * 16) AS INTEGER) AS j, CAST(floor(((\"row\" - 12) * depth / 32 + 0.375) * 16) AS INTEGER) AS k FROM pixels WHERE mask), d AS (SELECT c.*, " + ", ".join(f"{_near(a, 3)} - {_near(a, -3)} AS {x}" for a, x in zip("ijk", "xyz", strict=True)) + " FROM p c JOIN m ON c.scene_id = m.scene_id), l AS (SELECT *, CASE WHEN x*x + y*y + z*z = 0 THEN 1e-4 ELSE sqrt(x*x + y*y + z*z) END AS len FROM d)"


# The camera's axes are world y, z and x.
@query("w6_pixel_normals", W("pixels", "voxels") + _W6_PIXELS + ' SELECT q.scene_id, q.frame_id, q."row", q.col, CASE WHEN q.mask THEN round(y / len, 6) + 0 ELSE 0 END AS nx, CASE WHEN q.mask THEN round(z / len, 6) + 0 ELSE 0 END AS ny, CASE WHEN q.mask THEN round(x / len, 6) + 0 ELSE 0 END AS nz FROM pixels q LEFT JOIN l USING (scene_id, frame_id, "row", col)')
def w6_pixels(s, d):
    n = R.pixel_normals(V.pixels(s, d), V.frames(s, d), V.voxels(s, d), V.grids(s, d))
    return n.select("scene_id", "frame_id", "row", "col", *((F.round(c, 6) + 0).alias(c) for c in ("nx", "ny", "nz")))


@query("grid_tiles", W("voxels") + " SELECT * FROM voxels WHERE v IS NOT NULL")
def tiles(s, d):
    return R.unpack(R.pack(V.voxels(s, d), 4), 4)
