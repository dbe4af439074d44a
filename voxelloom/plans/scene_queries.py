"""Images, sampling, features, learning, meshes and dense jobs over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom import testviews as V
from voxelloom.functions import geometry as G
from voxelloom.functions import scalars as S
from voxelloom.operators import dense as D
from voxelloom.operators import features as X
from voxelloom.operators import grid as R
from voxelloom.operators import image as I
from voxelloom.operators import learn as L
from voxelloom.operators import mesh as M
from voxelloom.operators import sampling as T
from voxelloom.operators import tiles
from voxelloom.plans.registry import query, written

CELL, W = R.CELL, V.with_views
_LCG = 1_000_003


def lcg_unit(key, seed):
    """The congruential hash as a number in [0, 1), the same in SQL."""
    return S.lcg(key, seed, _LCG) / float(_LCG)


def lcg_sql(key: str, seed: int) -> str:
    return f"((({key}) * 48271 + {seed * 16807 + 11}) % {_LCG}) / {_LCG}.0"


def _grad(name: str, axis: str, step: str) -> str:
    other, last = ("col", 23) if axis == '"row"' else ('"row"', 31)
    w = f"OVER (PARTITION BY scene_id, frame_id, {other} ORDER BY {axis})"
    return f"CASE WHEN {axis} = 0 THEN (lead({name}) {w} - {name}) / {step} WHEN {axis} = {last} THEN ({name} - lag({name}) {w}) / {step} ELSE (lead({name}) {w} - lag({name}) {w}) / (2 * {step}) END"


_DENSE = ', dense AS (SELECT s_suppkey AS scene_id, CAST(f AS INTEGER) AS frame_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM supplier, range(4) a(f), range(24) b(r), range(32) d(c)), img AS (SELECT dense.*, depth AS z, (col - 16) * depth / 32 AS x, ("row" - 12) * depth / 32 AS y FROM dense LEFT JOIN pixels USING (scene_id, frame_id, "row", col))'
_G1 = ", g AS (SELECT *, " + ", ".join(f"{_grad(n, a, '2.0')} AS {n}{k}" for n in "xyz" for k, a in enumerate(('"row"', "col"))) + " FROM img)"
_U = ", u AS (SELECT *, nullif(sqrt(x0*x0 + y0*y0 + z0*z0), 0) AS l0, nullif(sqrt(x1*x1 + y1*y1 + z1*z1), 0) AS l1 FROM g), c AS (SELECT *, (y0*z1 - z0*y1) / (l0*l1) AS cx, (z0*x1 - x0*z1) / (l0*l1) AS cy, (x0*y1 - y0*x1) / (l0*l1) AS cz FROM u)"


@query("w1_normals", W("pixels") + _DENSE + _G1 + _U + ' SELECT scene_id, frame_id, "row", col, round(cx / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0), 6) + 0 AS nx, round(cy / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0), 6) + 0 AS ny, round(cz / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0), 6) + 0 AS nz FROM c')
def w1(s, d):
    n = I.normals(V.pixels(s, d), V.frames(s, d))
    return n.select(*I.PIXEL, *((F.round(c, 6) + 0).alias(c) for c in ("nx", "ny", "nz")))


_CURV = ", g AS (SELECT *, " + _grad("z", '"row"', "1.0") + " AS zr, " + _grad("z", "col", "1.0") + " AS zc FROM img), h AS (SELECT *, " + _grad("zr", '"row"', "1.0") + " AS zrr, " + _grad("zc", '"row"', "1.0") + " AS zcr, " + _grad("zc", "col", "1.0") + " AS zcc FROM g)"


@query("w2_curvature", W("pixels") + _DENSE + _CURV + ' SELECT scene_id, frame_id, "row", col, round(-((zc*zc + 1) * zrr - 2*zc*zr*zcr + (zr*zr + 1) * zcc) / (2 * power(zc*zc + zr*zr + 1, 1.5)), 6) + 0 AS h_mean, round((zcc*zrr - zcr*zcr) / power(zc*zc + zr*zr + 1, 2), 6) + 0 AS k_gauss, zrr AS z_row_row, zcc AS z_col_col FROM h')
def w2(s, d):
    c = I.curvature(V.pixels(s, d), V.frames(s, d))
    return c.select(*I.PIXEL, (F.round("h_mean", 6) + 0).alias("h_mean"), (F.round("k_gauss", 6) + 0).alias("k_gauss"), "z_row_row", "z_col_col")


_JUMP = ", g AS (SELECT *, " + _grad("z", '"row"', "1.0") + " AS zr, " + _grad("z", "col", "1.0") + ' AS zc FROM img), st AS (SELECT *, CASE WHEN sqrt(zr*zr + zc*zc) <= 0.6 THEN 0 ELSE 1 END AS steep FROM g), nr AS (SELECT *, greatest(max(steep) OVER (PARTITION BY scene_id, frame_id, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), max(steep) OVER (PARTITION BY scene_id, frame_id, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS near FROM st), p AS (SELECT scene_id, frame_id, "row" * 32 + col AS p FROM nr WHERE near = 0 AND "row" BETWEEN 2 AND 21 AND col BETWEEN 2 AND 29)'


@query("w7_jump_triangles", W("pixels") + _DENSE.replace("depth AS z", 'coalesce(depth, ("row" + col) / 64) AS z') + _JUMP + " SELECT scene_id, frame_id, p AS v0, p + 32 AS v1, p + 33 AS v2 FROM p UNION ALL SELECT scene_id, frame_id, p + 33, p + 1, p FROM p")
def w7(s, d):
    return I.jump_triangles(V.pixels(s, d), V.frames(s, d), jump=0.6, border=2, fill=lambda row, col: (row + col) / 64)


@query("f4_usable_pixels", W("pixels") + _DENSE + _G1 + _U + ' SELECT c.scene_id, c.frame_id, c."row", c.col FROM c JOIN pixels p ON p.scene_id = c.scene_id AND p.frame_id = c.frame_id AND p."row" = c."row" AND p.col = c.col WHERE mask AND cx*cx + cy*cy + cz*cz > 0')
def f4(s, d):
    return I.usable(I.normals(V.pixels(s, d), V.frames(s, d), kept=["mask"])).select(*I.PIXEL)


@query("f6_frames_and_regions", W("pixels") + ' SELECT scene_id, frame_id, "row", col, depth - 0.5 - frame_id / 8 AS x, (col - 16) * depth / 32 + 0.25 AS y, ("row" - 12) * depth / 32 + 0.375 AS z FROM pixels WHERE mask AND frame_id IN (1, 3)')
def f6(s, d):
    return I.region_points(I.some_frames(V.pixels(s, d), [1, 3]), F.col("mask"), V.frames(s, d))


@query("f7_crop_to_mask", W("pixels") + ', b AS (SELECT scene_id, frame_id, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pixels WHERE mask GROUP BY 1, 2) SELECT scene_id, frame_id, "row" - r0 AS "row", col - c0 AS col, depth, mask FROM pixels JOIN b USING (scene_id, frame_id) WHERE "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1')
def f7(s, d):
    return I.crop_to_mask(V.pixels(s, d))


_ROWSQL = ", r AS (SELECT scene_id, i, j, list(v ORDER BY k) AS vals FROM voxels GROUP BY 1, 2, 3)"


@query("f8_drop_unknown", W("voxels") + _ROWSQL + " SELECT * FROM r WHERE len(list_filter(vals, lambda x: x IS NULL)) = 0")
def f8(s, d):
    rows = V.voxels(s, d).groupBy("scene_id", "i", "j").agg(X.ordered("k", F.col("v")).alias("vals"))
    return X.drop_unknown(rows, "vals")


@query("f9_training_check", W("examples") + " SELECT * FROM examples")
def f9(s, d):
    X.check_training_rows(V.examples(s, d), "x", "y")
    return V.examples(s, d)


@query("v1_bilateral_depth")
def v1(s, d):
    return I.bilateral_depth(V.pixels(s, d))


@query("v2_median_depth")
def v2(s, d):
    return I.median_depth(V.pixels(s, d))


_WEIGHTS = ', w AS (SELECT scene_id, frame_id, "row", col, depth AS w, sum(depth) OVER (PARTITION BY scene_id, frame_id ORDER BY "row", col) AS hi, sum(depth) OVER (PARTITION BY scene_id, frame_id) AS total FROM pixels WHERE mask)'


@query("t1_weighted_sampling", W("pixels") + _WEIGHTS + ', dr AS (SELECT DISTINCT scene_id, frame_id, CAST(q AS INTEGER) AS sample_id, total * (' + lcg_sql("scene_id * 7919 + frame_id * 104729 + q", 3) + ') AS u FROM w, range(5) r(q)) SELECT scene_id, frame_id, sample_id, "row", col FROM dr JOIN w USING (scene_id, frame_id) WHERE u < hi AND u >= hi - w')
def t1(s, d):
    weight = T.surface_weight(F.col("depth"), F.col("mask"), F.lit(0.0))
    return T.weighted(V.pixels(s, d), weight, 5, 3, lcg_unit)


# Every rule that sets a weight to 0: off the mask, facing up, near the floor, without a label, seen edge-on.
_RULES = ', w0 AS (SELECT *, CASE WHEN mask AND NOT ("row" * 7 + col * 3) % 100 / 100 > 0.98 AND NOT ("row" % 24) / 64 < 0.035 AND ("row" + col) % 5 <> 0 AND NOT (col * 5 + "row") % 16 / 16 - 0.75 > -0.1 THEN depth ELSE 0 END AS w FROM pixels), w AS (SELECT scene_id, frame_id, "row", col, w, sum(w) OVER (PARTITION BY scene_id, frame_id ORDER BY "row", col) AS hi, sum(w) OVER (PARTITION BY scene_id, frame_id) AS total FROM w0 WHERE w > 0)'


@query("t1_surface_sampling", W("pixels") + _RULES + ', dr AS (SELECT DISTINCT scene_id, frame_id, CAST(q AS INTEGER) AS sample_id, total * (' + lcg_sql("scene_id * 7919 + frame_id * 104729 + q", 3) + ') AS u FROM w, range(5) r(q)) SELECT scene_id, frame_id, sample_id, "row", col FROM dr JOIN w USING (scene_id, frame_id) WHERE u < hi AND u >= hi - w')
def t1_rules(s, d):
    r, c = F.col("row"), F.col("col")
    label = F.when((r + c) % 5 != 0, 1)
    weight = T.surface_weight(F.col("depth"), F.col("mask"), (r * 7 + c * 3) % 100 / 100, r % 24 / 64, label, (c * 5 + r) % 16 / 16 - 0.75)
    return T.weighted(V.pixels(s, d), weight, 5, 3, lcg_unit)


@query("t2_uniform_in_mask", W("pixels") + ', k AS (SELECT scene_id, frame_id, "row", col, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY "row", col) - 1 AS pos FROM pixels WHERE mask), n AS (SELECT scene_id, frame_id, count(*) AS n FROM k GROUP BY 1, 2), dr AS (SELECT scene_id, frame_id, CAST(q AS INTEGER) AS sample_id, CAST(floor((' + lcg_sql("scene_id * 7919 + frame_id * 104729 + q", 5) + ') * n) AS INTEGER) AS pos FROM n, range(4) r(q)) SELECT scene_id, frame_id, sample_id, "row", col FROM dr JOIN k USING (scene_id, frame_id, pos)')
def t2(s, d):
    return T.uniform_in_mask(V.pixels(s, d), F.col("mask"), 4, 5, lcg_unit)


@query("t3_without_replacement", W("examples") + " SELECT * FROM examples ORDER BY " + lcg_sql("example_id", 7) + ", example_id LIMIT 100")
def t3(s, d):
    return T.without_replacement(V.examples(s, d), "example_id", 100, 7, lcg_unit)


_BAGS = ", sc AS (SELECT DISTINCT scene_id FROM examples), rk AS (SELECT scene_id, CAST(t AS INTEGER) AS tree_id, row_number() OVER (PARTITION BY t ORDER BY " + lcg_sql("scene_id * 31 + t", 9) + ", scene_id) AS r, count(*) OVER (PARTITION BY t) AS n FROM sc, range(4) q(t)), ro AS (SELECT e.example_id, e.scene_id, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY " + lcg_sql("example_id * 37 + tree_id", 10) + ", example_id) AS r FROM examples e JOIN rk USING (scene_id) WHERE rk.r <= ceil(n * 0.5)), bags AS (SELECT tree_id, example_id FROM ro WHERE r <= 100000)"


#: The reference's subsample_length: the most rows a tree is trained on.
BAG_ROWS = 100_000


def _bags(s, d):
    return T.bag_scenes(V.examples(s, d), 4, 0.5, BAG_ROWS, 9, lcg_unit)


@query("t4_bags", W("examples") + _BAGS + " SELECT * FROM bags")
def t4(s, d):
    return _bags(s, d).select("tree_id", "example_id")


@query("t4_row_bags", W("examples") + " SELECT CAST(t AS INTEGER) AS tree_id, example_id FROM examples, range(4) q(t) WHERE " + lcg_sql("example_id * 37 + t", 9) + " < 0.5")
def t4_rows(s, d):
    return T.bag_rows(V.examples(s, d), 4, 0.5, 9, lcg_unit).select("tree_id", "example_id")


@query("j13_out_of_bag", W("examples") + _BAGS + " SELECT CAST(t AS INTEGER) AS tree_id, example_id FROM examples, range(4) q(t) WHERE NOT EXISTS (SELECT 1 FROM bags WHERE bags.tree_id = t AND bags.example_id = examples.example_id)")
def j13(s, d):
    return T.out_of_bag(V.examples(s, d), _bags(s, d), 4).select("tree_id", "example_id")


@query("t5_model_choice", W("samples") + " SELECT event_id, CASE WHEN " + lcg_sql("event_id", 4) + " < 0.5 THEN 'short' ELSE 'tall' END AS model FROM samples")
def t5(s, d):
    return T.pick_model(V.samples(s, d), F.col("event_id"), [("short", 0.5), ("tall", 0.5)], 4, lcg_unit).select("event_id", "model")


@query("s5_split_manifest", "WITH m AS (SELECT 'train' AS split, n_name AS name, n_nationkey AS pos FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'test', n_name, n_nationkey FROM nation WHERE n_regionkey >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY pos) AS r FROM m) SELECT split, name, pos FROM r WHERE r <= 4")
def s5(s, d):
    n = V.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"), "n_regionkey")
    split = lambda name, cond: n.where(cond).select(F.lit(name).alias("split"), "name", "pos")
    return T.first_n(split("train", "n_regionkey < 3").unionByName(split("test", "n_regionkey >= 3")), ["pos"], 4, ["split"])


@query("s6_sequence_names", "SELECT n_name || '_[' || CAST(f AS VARCHAR) || ']' AS name, n_name AS scene, CAST(f AS INTEGER) AS frame FROM nation, range(3) q(f)")
def s6(s, d):
    n = V.table(s, d, "nation").select(F.col("n_name").alias("scene"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"))
    return n.select(F.concat("scene", F.lit("_["), F.col("frame").cast("string"), F.lit("]")).alias("name"), "scene", "frame")


@query("s7_folder_paths", "SELECT n_nationkey, '/data/fold_' || CAST(n_regionkey % 2 AS VARCHAR) || '/' || n_name || '/' AS folder FROM nation")
def s7(s, d):
    from voxelloom.sources.manifests import moved_folder

    n = V.table(s, d, "nation").select("n_nationkey", F.concat(F.lit("/old/place/"), "n_name", F.lit("/")).alias("folder"), "n_regionkey")
    return n.select("n_nationkey", moved_folder(F.col("folder"), F.concat(F.lit("/data/fold_"), (F.col("n_regionkey") % 2).cast("string"))).alias("folder"))


@query("u1_stacked_examples", W("examples") + " SELECT example_id, scene_id, x, y FROM examples WHERE scene_id IN (SELECT DISTINCT scene_id FROM examples ORDER BY scene_id LIMIT 3)")
def u1(s, d):
    e = V.examples(s, d)
    scenes = e.select("scene_id").distinct().orderBy("scene_id").limit(3)
    even, odd = e.where("example_id % 2 = 0"), e.where("example_id % 2 = 1")
    return even.unionByName(odd).join(F.broadcast(scenes), "scene_id").select("example_id", "scene_id", "x", "y")  # three rows


def _pixel_samples(s, d):
    """Every masked pixel, as a sample."""
    p = V.pixels(s, d).where("mask")
    return p.select("scene_id", "frame_id", (F.col("row") * 32 + F.col("col")).alias("sample_id"), "row", "col")


_COB = """, smp AS (SELECT scene_id, frame_id, "row" * 32 + col AS sample_id, "row" AS r0, col AS c0, depth AS d0 FROM pixels WHERE mask),
sl AS (SELECT r, a, r * 8 + a AS slot, [0, 0.7071067811865475, 1, 0.7071067811865476, 1.2246467991473532e-16, -0.7071067811865475, -1, -0.7071067811865477][a + 1] AS sn, [1, 0.7071067811865476, 6.123233995736766e-17, -0.7071067811865475, -1, -0.7071067811865477, -1.8369701987210297e-16, 0.7071067811865474][a + 1] AS cs FROM range(3) p(r), range(8) q(a)),
lk AS (SELECT scene_id, frame_id, sample_id, slot, d0, CAST(trunc(r0 - 1.6 / d0 * (r + 1.0) * sn) AS INTEGER) AS "row", CAST(trunc(c0 + 1.6 / d0 * (r + 1.0) * cs) AS INTEGER) AS col FROM smp, sl)
SELECT scene_id, frame_id, sample_id, list(depth - d0 ORDER BY slot) AS cobweb FROM lk LEFT JOIN pixels USING (scene_id, frame_id, "row", col) GROUP BY 1, 2, 3"""


@query("v6_cobweb", W("pixels") + _COB)
def v6(s, d):
    return X.cobweb(_pixel_samples(s, d), V.pixels(s, d), V.frames(s, d), t=0.05, radii=3)


def _sampled_points(s, d):
    return V.samples(s, d).withColumnRenamed("event_id", "sample_id")


@query("v7_ring_samples")
def v7(s, d):
    return X.ring_samples(_sampled_points(s, d), V.grids(s, d), V.voxels(s, d), 0.0625, 2)


BLOCK, STEP = (4, 4, 4), 0.0625


def _blocks(s, d):
    """Blocks at the samples, turned by multiples of 90 degrees so that places are exact."""
    n = [F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0), F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(1.0), F.lit(0.0)]
    rot, origin = G.block_frame(G.columns("x", "y", "z"), n, BLOCK, STEP, (0.5, 0.5, 0.5), False)
    return R.evaluated(V.samples(s, d), rot=rot, origin=origin).select("scene_id", F.col("event_id").alias("sample_id"), "rot", "origin")


# For n = x: block axes are x' = y, y' = -x; for n = y: x' = -x, y' = -y. The block's centre is the point.
_BLOCKS = """, b AS (SELECT event_id, s.scene_id, a * 16 + b * 4 + c AS lin, (a + 0.5) / 16 - 0.125 AS p, (b + 0.5) / 16 - 0.125 AS q, (c + 0.5) / 16 - 0.125 AS r, x, y, z FROM samples s, range(4) i1(a), range(4) i2(b), range(4) i3(c)),
w AS (SELECT event_id, scene_id, lin, CAST(floor((CASE WHEN event_id % 2 = 0 THEN x - q ELSE x - p END) * 16) AS INTEGER) AS i, CAST(floor((CASE WHEN event_id % 2 = 0 THEN y + p ELSE y - q END) * 16) AS INTEGER) AS j, CAST(floor((z + r) * 16) AS INTEGER) AS k FROM b)
"""


@query("v5_cut_blocks", W("samples", "voxels") + _BLOCKS + "SELECT w.scene_id, event_id AS sample_id, list(v ORDER BY lin) AS vals FROM w LEFT JOIN voxels USING (scene_id, i, j, k) GROUP BY 1, 2")
def v5(s, d):
    return D.cut_blocks(_blocks(s, d), V.voxels(s, d), V.grids(s, d), BLOCK, STEP)


@query("x1_post_transform", W("samples", "voxels") + _BLOCKS + "SELECT w.scene_id, event_id AS sample_id, list(CASE WHEN v IS NULL THEN 0.5 ELSE v * 2 END ORDER BY lin) AS vals FROM w LEFT JOIN voxels USING (scene_id, i, j, k) GROUP BY 1, 2")
def x1(s, d):
    return D.cut_blocks(_blocks(s, d), V.voxels(s, d), V.grids(s, d), BLOCK, STEP, initial=0.25, post_transform=lambda v: v * 2)


_LABELLED = """, lab AS (SELECT scene_id, i, j, k, v, CASE WHEN v < 0 THEN (i + j) % 4 ELSE 0 END AS label FROM voxels),
own AS (SELECT event_id, coalesce(label, 0) AS label FROM samples s LEFT JOIN lab ON lab.scene_id = s.scene_id AND lab.i = floor(x * 16) AND lab.j = floor(y * 16) AND lab.k = floor(z * 16))
SELECT w.scene_id, w.event_id AS sample_id, list(CASE WHEN own.label = 0 OR lab.label = 0 OR lab.label = own.label THEN v END ORDER BY lin) AS vals
FROM w JOIN own ON own.event_id = w.event_id LEFT JOIN lab ON lab.scene_id = w.scene_id AND lab.i = w.i AND lab.j = w.j AND lab.k = w.k GROUP BY 1, 2"""


@query("v5_cut_by_label", W("samples", "voxels") + _BLOCKS + _LABELLED)
def v5_label(s, d):
    """Each block from the cells of its own point's label and of none; unlabelled points take the whole grid."""
    labels = V.voxels(s, d).select(*CELL, F.when(F.col("v") < 0, (F.col("i") + F.col("j")) % 4).otherwise(0).alias("label"))
    at = R.locate(V.samples(s, d), V.grids(s, d)).join(labels, CELL, "left").select(F.col("event_id").alias("sample_id"), "label")
    return D.cut_blocks(_blocks(s, d).join(at, "sample_id"), V.voxels(s, d), V.grids(s, d), BLOCK, STEP, labels=labels)


@query("x2_per_scene", W("voxels") + " SELECT scene_id, count(*) AS n, count(CASE WHEN v < 0 THEN 1 END) AS n_solid FROM voxels GROUP BY 1")
def x2(s, d):
    import pandas as pd

    def f(pdf):
        return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[:1], "n": [len(pdf)], "n_solid": [int((pdf["v"] < 0).sum())]})

    return I.per_scene(V.voxels(s, d), f, "scene_id long, n long, n_solid long")


@query("j14_footprints", W("samples", "cells") + ", p AS (SELECT event_id, c.scene_id, c.i, c.j, CASE WHEN event_id % 2 = 0 THEN c.y - s.y ELSE s.x - c.x END AS a, CASE WHEN event_id % 2 = 0 THEN s.x - c.x ELSE s.y - c.y END AS b FROM samples s JOIN cells c ON s.scene_id = c.scene_id AND c.k = 0) SELECT scene_id, event_id AS sample_id, i, j FROM p WHERE a >= -0.125 AND a < 0.125 AND b >= -0.125 AND b < 0.125")
def j14(s, d):
    return X.footprints(_blocks(s, d), V.grids(s, d), BLOCK, STEP)


def _placed(s, d):
    """Cells reached by each sample's block, with dyadic predicted values."""
    rows = V.samples(s, d).select("scene_id", F.col("event_id").alias("sample_id"), F.floor(F.col("x") * 8).cast("int").alias("i"), F.floor(F.col("y") * 8).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.withColumn("v", ((F.col("sample_id") * 7 + F.col("k") * 3) % 16) / 16 - 0.5)


_PLACED = ", placed AS (SELECT scene_id, event_id AS sample_id, CAST(floor(x * 8) AS INTEGER) AS i, CAST(floor(y * 8) AS INTEGER) AS j, CAST(k AS INTEGER) AS k, ((event_id * 7 + k * 3) % 16) / 16 - 0.5 AS v FROM samples, range(4) q(k))"


@query("w5_prefix_averages", W("samples") + _PLACED + ", rk AS (SELECT scene_id, event_id AS sample_id, row_number() OVER (PARTITION BY scene_id ORDER BY abs(nx), event_id) - 1 AS r FROM samples) SELECT CAST(stop AS INTEGER) AS stop, scene_id, i, j, k, round(avg(v), 9) AS v, count(*) AS n FROM placed JOIN rk USING (scene_id, sample_id), (VALUES (0), (5), (20)) s(stop) WHERE r <= stop GROUP BY 1, 2, 3, 4, 5")
def w5(s, d):
    dist = V.samples(s, d).select("scene_id", F.col("event_id").alias("sample_id"), F.abs("nx").alias("dist"))
    return D.prefix_averages(_placed(s, d), dist, [0, 5, 20]).withColumn("v", F.round("v", 9))


@query("v14_greedy_accept")
def v14(s, d):
    return D.greedy_accept(_placed(s, d), V.voxels(s, d))


@query("a20_pointwise_fit", W("samples") + _PLACED + " SELECT scene_id, sample_id, round(avg(abs(v)), 9) AS fit, count(*) AS n FROM placed WHERE (i + j + k) % 2 = 0 GROUP BY 1, 2")
def a20(s, d):
    points = _placed(s, d).where("(i + j + k) % 2 = 0").select("scene_id", "sample_id", "i", "j", "k")
    return D.pointwise_fit(points, _placed(s, d)).withColumn("fit", F.round("fit", 9))


@query("v3_segmentation")
def v3(s, d):
    return D.segment(V.voxels(s, d), V.grids(s, d), 1, 3, radius=2)


# The distance is clipped at four cells, so only offsets that near matter.
_EDT = """, o AS (SELECT c.scene_id, c.i, c.j, c.k, coalesce(v < 0, false) AS solid FROM cells c LEFT JOIN voxels USING (scene_id, i, j, k)),
f AS (SELECT a - 4 AS a, b - 4 AS b, c - 4 AS c, power(a - 4, 2) + power(b - 4, 2) + power(c - 4, 2) AS d2 FROM range(9) p(a), range(9) q(b), range(9) r(c)),
n AS (SELECT o.scene_id, o.i, o.j, o.k, min(d2) AS d2 FROM o, f, o t WHERE d2 BETWEEN 1 AND 16 AND t.scene_id = o.scene_id AND t.i = o.i + f.a AND t.j = o.j + f.b AND t.k = o.k + f.c AND t.solid <> o.solid GROUP BY 1, 2, 3, 4),
s AS (SELECT scene_id, bool_or(solid) AND NOT bool_and(solid) AS mixed FROM o GROUP BY 1)
SELECT o.scene_id, o.i, o.j, o.k, CASE WHEN mixed THEN round((CASE WHEN solid THEN -1 ELSE 1 END) * coalesce(sqrt(d2) / 16, 0.25), 9) END AS v FROM o JOIN s ON o.scene_id = s.scene_id LEFT JOIN n ON n.scene_id = o.scene_id AND n.i = o.i AND n.j = o.j AND n.k = o.k"""


@query("v15_signed_distance", W("voxels", "cells") + _EDT)
def v15(s, d):
    occupied = V.voxels(s, d).select(*CELL, F.coalesce(F.col("v") < 0, F.lit(False)).alias("solid"))
    return D.signed_distance(occupied, V.VOX, V.MU, V.grids(s, d)).withColumn("v", F.round("v", 9))


@query("j11_nearest", W("examples") + ", e AS (SELECT q.example_id AS query_id, t.example_id AS nn_id, sqrt(list_sum([power(q.x[n] - t.x[n], 2) for n in range(1, 33)])) AS dist FROM examples q, examples t WHERE q.example_id % 20 = 0 AND t.example_id <> q.example_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), nn_id) AS r FROM e) SELECT query_id, nn_id, round(dist, 6) AS dist FROM r WHERE r = 1")
def j11(s, d):
    e = V.examples(s, d)
    q = e.where("example_id % 20 = 0").select(F.col("example_id").alias("query_id"), "x")
    return L.nearest(q, e, "query_id", "example_id", "x", others=True).withColumn("dist", F.round("dist", 6))


@query("a16_group_medoids", W("examples") + ", l AS (SELECT scene_id, example_id, unnest(y) AS y, unnest(range(32)) AS d FROM examples), m AS (SELECT scene_id, d, avg(y) AS m FROM l GROUP BY 1, 2), q AS (SELECT l.scene_id, example_id, round(sum(power(y - m, 2)), 9) AS dist FROM l JOIN m USING (scene_id, d) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY dist, example_id) AS r FROM q) SELECT scene_id, example_id AS medoid_id FROM r WHERE r = 1")
def a16(s, d):
    return L.group_medoids(V.examples(s, d), "scene_id", "example_id", "y")


def literal_forest(s):
    """Two trees of depth 2, for checks against SQL."""
    rows = []
    for t, (root, left, right) in enumerate((((0, 0.0), (1, 0.0), (2, 0.0)), ((3, 0.0), (4, 0.0625), None))):
        rows += [("m", t, 0, False, root[0], root[1], 0.5, 500, 0), ("m", t, 1, False, left[0], left[1], 0.4, 300, 11)]
        rows += [("m", t, 2, right is None, right and right[0], right and right[1], 0.3, 200, 12)]
        rows += [("m", t, 3, True, None, None, 0.1, 100, 13), ("m", t, 4, True, None, None, 0.2, 200, 14)]
        rows += [("m", t, 5, True, None, None, 0.1, 150, 15), ("m", t, 6, True, None, None, 0.0, 50, 16)] if right else []
    return s.createDataFrame(rows, L.NODES)


_FOREST = " SELECT example_id, 0 AS tree_id, CAST(CASE WHEN x[1] < 0 THEN CASE WHEN x[3] < 0 THEN 6 ELSE 5 END ELSE CASE WHEN x[2] < 0 THEN 4 ELSE 3 END END AS BIGINT) AS node_id FROM examples UNION ALL SELECT example_id, 1, CAST(CASE WHEN x[4] < 0 THEN 2 ELSE CASE WHEN x[5] < 0.0625 THEN 4 ELSE 3 END END AS BIGINT) FROM examples"


@query("v10_forest_apply", W("examples") + f", f AS ({_FOREST}) SELECT *, node_id + 10 AS medoid_id FROM f")
def v10(s, d):
    return L.apply_forest(V.examples(s, d), literal_forest(s), "example_id", "x")


@query("v10_forest_apply_joins", W("examples") + f", f AS ({_FOREST}) SELECT *, node_id + 10 AS medoid_id FROM f")
def v10_joins(s, d):
    return L.apply_forest_joins(V.examples(s, d), literal_forest(s), "example_id", "x", 2)


# Nodes that examples reach at each depth, with their number and the Gini impurity of a target bit.
_NODES = """, p AS (
SELECT example_id, y, 0 AS tree_id, unnest([0, CASE WHEN x[1] < 0 THEN 2 ELSE 1 END, CASE WHEN x[1] < 0 THEN CASE WHEN x[3] < 0 THEN 6 ELSE 5 END ELSE CASE WHEN x[2] < 0 THEN 4 ELSE 3 END END]) AS node_id FROM examples
UNION ALL SELECT example_id, y, 1, unnest(CASE WHEN x[4] < 0 THEN [0, 2] ELSE [0, 1, CASE WHEN x[5] < 0.0625 THEN 4 ELSE 3 END] END) FROM examples),
nodes AS (SELECT tree_id, CAST(node_id AS BIGINT) AS node_id, count(*) AS num_exs, 1 - power(avg(CASE WHEN y[1] > 0 THEN 1 ELSE 0 END), 2) - power(1 - avg(CASE WHEN y[1] > 0 THEN 1 ELSE 0 END), 2) AS impurity,
          node_id > 2 OR (tree_id = 1 AND node_id = 2) AS is_leaf, CASE WHEN tree_id = 0 THEN CASE node_id WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END ELSE CASE node_id WHEN 0 THEN 3 WHEN 1 THEN 4 END END AS dim FROM p GROUP BY tree_id, p.node_id)"""


def measured_forest(s, d):
    """The literal forest with the rows and impurities that the examples give its nodes."""
    e, forest = V.examples(s, d), literal_forest(s)
    at = [L.apply_forest(e, forest, "example_id", "x", depth).select("example_id", "tree_id", "node_id") for depth in range(3)]
    seen = at[0].unionByName(at[1]).unionByName(at[2]).distinct()  # a leaf is reached at every depth from its own
    return L.measured(forest, seen.join(e.select("example_id", (F.col("y")[0] > 0).alias("bit")), "example_id"))


@query("v11_literal_leaves", W("examples") + _NODES + " SELECT tree_id, node_id, num_exs, round(impurity, 9) AS impurity FROM nodes WHERE is_leaf")
def v11_literal(s, d):
    return L.leaves(measured_forest(s, d)).select("tree_id", "node_id", "num_exs", F.round("impurity", 9).alias("impurity"))


# Only the root of the first tree has two children that split.
_IMP = """, g AS (SELECT n.tree_id, n.dim, n.impurity * n.num_exs - l.impurity * l.num_exs - r.impurity * r.num_exs AS gain FROM nodes n JOIN nodes l ON l.tree_id = n.tree_id AND l.node_id = 2 * n.node_id + 1 JOIN nodes r ON r.tree_id = n.tree_id AND r.node_id = 2 * n.node_id + 2 WHERE NOT n.is_leaf AND NOT l.is_leaf AND NOT r.is_leaf),
t AS (SELECT tree_id, sum(gain) AS total FROM g GROUP BY 1)
SELECT dim, round(sum(gain / nullif(total, 0)) / 2, 9) AS importance FROM g JOIN t USING (tree_id) GROUP BY 1"""


@query("a22_literal_importance", W("examples") + _NODES + _IMP)
def a22_literal(s, d):
    return L.importance(measured_forest(s, d)).withColumn("importance", F.round("importance", 9))


_R2 = """, f AS ({forest}), o AS (SELECT f.example_id, f.tree_id, node_id + 10 AS medoid_id FROM f WHERE (f.example_id * 7 + f.tree_id * 3) % 4 = 0),
l AS (SELECT o.tree_id, o.example_id, unnest(range(32)) AS d, unnest(e.y) AS t, unnest(m.y) AS p FROM o JOIN examples e ON e.example_id = o.example_id JOIN examples m ON m.example_id = o.medoid_id),
w AS (SELECT *, avg(t) OVER (PARTITION BY tree_id, d) AS m FROM l)
SELECT CAST(tree_id AS INTEGER) AS tree_id, round(1 - sum(power(p - t, 2)) / nullif(sum(power(t - m, 2)), 0), 9) AS r2 FROM w GROUP BY 1"""


@query("a21_literal_oob_r2", W("examples") + _R2.replace("{forest}", _FOREST))
def a21_literal(s, d):
    """Each tree of the literal forest scored on the quarter of the rows that its bag leaves out."""
    e = V.examples(s, d)
    found = L.apply_forest(e, literal_forest(s), "example_id", "x")
    trees = e.select("example_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("tree_id"))
    unseen = T.out_of_bag(e, trees.where("(example_id * 7 + tree_id * 3) % 4 <> 0"), 2).select("tree_id", "example_id")
    medoids = e.select(F.col("example_id").alias("medoid_id"), F.col("y").alias("pred"))
    pred = found.join(unseen, ["tree_id", "example_id"]).join(medoids, "medoid_id").select("tree_id", "example_id", "pred")
    return L.oob_r2(pred, e).withColumn("r2", F.round("r2", 9))


@query("v9_train_forest")
def v9(s, d):
    return L.train_forest(_bags(s, d), "m", tests=64, depth=6, pca_dims=16)


def _trained(s, d):
    return written(v9(s, d))


@query("v11_leaves")
def v11(s, d):
    return L.leaves(v9(s, d))


@query("a22_importance")
def a22(s, d):
    return L.importance(_trained(s, d))


@query("a23_split_scores", W("examples") + ", t AS (SELECT CAST(q AS INTEGER) AS test_id, CAST(q AS INTEGER) AS dim, 0.03125 AS thresh FROM range(8) r(q)), c AS (SELECT test_id, count(*) AS n, count(CASE WHEN x[dim + 1] < thresh THEN 1 END) AS n_r, count(CASE WHEN x[dim + 1] < thresh AND y[1] > 0 THEN 1 END) AS o_r, count(CASE WHEN NOT x[dim + 1] < thresh AND y[1] > 0 THEN 1 END) AS o_l FROM examples, t GROUP BY 1) SELECT test_id, n, n_r, round((n_r * (1 - power(o_r / n_r, 2) - power(1 - o_r / n_r, 2)) + (n - n_r) * (1 - power(o_l / (n - n_r), 2) - power(1 - o_l / (n - n_r), 2))) / n, 9) AS score FROM c")
def a23(s, d):
    tests = s.range(8).select(F.col("id").cast("int").alias("test_id"), F.col("id").cast("int").alias("dim"), F.lit(0.03125).alias("thresh"))
    rows = V.examples(s, d).select("x", (F.col("y")[0] > 0).alias("bit"))
    return L.split_scores(rows, tests).withColumn("score", F.round("score", 9))


@query("a21_oob_r2")
def a21(s, d):
    e = V.examples(s, d)
    found = L.apply_forest(e, _trained(s, d), "example_id", "x")
    unseen = T.out_of_bag(e, _bags(s, d), 4).select("tree_id", "example_id")
    medoids = e.select(F.col("example_id").alias("medoid_id"), F.col("y").alias("pred"))
    return L.oob_r2(found.join(unseen, ["tree_id", "example_id"]).join(medoids, "medoid_id").select("tree_id", "example_id", "pred"), e)


@query("v8_pca")
def v8(s, d):
    mean, parts = L.fit_pca(V.examples(s, d), "x", 8)
    coded = L.pca_transform(V.examples(s, d), "x", "code", mean, parts)
    return L.pca_inverse(coded, "code", "restored", mean, parts).select("example_id", "code", "restored")


@query("t6_choose_closest")
def t6(s, d):
    """Tree predictions of every example, the one nearest to the true targets chosen."""
    e = V.examples(s, d)
    found = L.apply_forest(e, _trained(s, d), "example_id", "x")
    medoids = e.select(F.col("example_id").alias("medoid_id"), F.col("y").alias("vals"))
    c = found.join(medoids, "medoid_id").join(e.select("example_id", "scene_id", F.col("y").alias("visible")), "example_id")
    return D.choose(c.select("scene_id", F.col("example_id").alias("sample_id"), "tree_id", "medoid_id", "vals", "visible"), "closest", "narrow_band")


# Candidates of the literal forest: each example's two blocks, and what is seen of it, a fifth of the cells unknown.
_CAND = """, f AS ({forest}), c AS (SELECT e.scene_id, f.example_id, f.tree_id, node_id + 10 AS medoid_id, unnest(range(32)) AS d, unnest(m.y) AS p, unnest(e.y) AS t FROM f JOIN examples e ON e.example_id = f.example_id JOIN examples m ON m.example_id = f.node_id + 10),
s AS (SELECT *, CASE WHEN d % 5 = 0 THEN -0.25 ELSE t END AS v, d % 4 = 0 AS o FROM c),
r AS (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high FROM s WINDOW w AS (PARTITION BY example_id, tree_id)),
k AS (SELECT *, v > 0.9 * low AS seen, p > 0.9 * low AS free, v > 0.9 * low AND v < 0.9 * high AS band FROM r)""".replace("{forest}", _FOREST)
_DIST = {
    "pointwise": "avg(CASE WHEN o THEN abs(p) END)",
    "just_empty": "sqrt(coalesce(sum(CASE WHEN seen AND (v > 0) <> (p > 0) THEN 1 END), 0))",
    "narrow_band": "sqrt(avg(CASE WHEN band THEN power(v - p, 2) END))",
    "largest_of_free_zones": "CASE WHEN count(CASE WHEN seen THEN 1 END) > count(CASE WHEN free THEN 1 END) THEN sqrt(sum(CASE WHEN seen THEN power(v - p, 2) END)) / count(CASE WHEN seen THEN 1 END) ELSE sqrt(sum(CASE WHEN free THEN power(v - p, 2) END)) / nullif(count(CASE WHEN free THEN 1 END), 0) END",
}
_PICK = """, m AS (SELECT scene_id, example_id AS sample_id, tree_id, medoid_id, list(p ORDER BY d) AS vals, {dist} AS dist FROM k GROUP BY 1, 2, 3, 4),
q AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(round(dist, 9), 1e300), tree_id) AS r FROM m)
SELECT scene_id, sample_id, medoid_id, round(dist, 6) AS min_dist, vals FROM q WHERE r = 1"""


def _candidates(s, d):
    e = V.examples(s, d)
    found = L.apply_forest(e, literal_forest(s), "example_id", "x")
    medoids = e.select(F.col("example_id").alias("medoid_id"), F.col("y").alias("vals"))
    visible = F.transform("y", lambda v, n: F.when(n % 5 != 0, v))
    seen = e.select("example_id", "scene_id", visible.alias("visible"), F.expr("sequence(0, 28, 4)").alias("observed"))
    return found.join(medoids, "medoid_id").join(seen, "example_id").withColumnRenamed("example_id", "sample_id")


def _chosen(measure):
    def q(s, d):
        return D.choose(_candidates(s, d), "closest", measure).withColumn("min_dist", F.round("min_dist", 6))

    return q


for _measure, _dist in _DIST.items():
    query(f"t6_{_measure}", W("examples") + _CAND + _PICK.replace("{dist}", _dist))(_chosen(_measure))


@query("t6_mean", W("examples") + _CAND + ", m AS (SELECT scene_id, example_id AS sample_id, d, avg(p) AS v FROM k GROUP BY 1, 2, 3) SELECT scene_id, sample_id, CAST(-1 AS BIGINT) AS medoid_id, CAST(0 AS DOUBLE) AS min_dist, list(v ORDER BY d) AS vals FROM m GROUP BY 1, 2")
def t6_mean(s, d):
    return D.choose(_candidates(s, d), "mean")


# Of two candidates both are as far from their mean, so the first tree's is taken.
@query("t6_medioid", W("examples") + _CAND + " SELECT scene_id, example_id AS sample_id, medoid_id, CAST(0 AS DOUBLE) AS min_dist, list(p ORDER BY d) AS vals FROM k WHERE tree_id = 0 GROUP BY 1, 2, 3")
def t6_medioid(s, d):
    return D.choose(_candidates(s, d), "medioid")


def _mesh(s, d):
    """A grid of vertices over each brand's parts, and triangles between them; every 97th vertex is unknown."""
    p = V.table(s, d, "part")
    v = p.select((F.col("p_partkey") % 4).alias("mesh_id"), F.floor(F.col("p_partkey") / 4).alias("vid"))
    known = F.col("vid") % 97 != 96
    v = v.select("mesh_id", "vid", F.when(known, (F.col("vid") % 8).cast("double")).alias("x"), F.when(known, F.floor(F.col("vid") / 8).cast("double")).alias("y"), F.when(known, (F.col("vid") * 5 % 7) / 4.0).alias("z"))
    last = v.groupBy("mesh_id").agg(F.max("vid").alias("last"))
    f = v.join(last, "mesh_id").where("vid % 8 < 7 AND vid + 9 <= last")
    return v, f.select("mesh_id", F.col("vid").alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 9).alias("v2"))


_MESH = "WITH v0 AS (SELECT p_partkey % 4 AS mesh_id, CAST(floor(p_partkey / 4) AS BIGINT) AS vid FROM part), v AS (SELECT mesh_id, vid, CASE WHEN vid % 97 <> 96 THEN CAST(vid % 8 AS DOUBLE) END AS x, CASE WHEN vid % 97 <> 96 THEN floor(vid / 8) END AS y, CASE WHEN vid % 97 <> 96 THEN (vid * 5 % 7) / 4 END AS z FROM v0), f AS (SELECT mesh_id, vid AS fid, vid AS a, vid + 1 AS b, vid + 9 AS c FROM v0 JOIN (SELECT mesh_id, max(vid) AS last FROM v0 GROUP BY 1) USING (mesh_id) WHERE vid % 8 < 7 AND vid + 9 <= last)"


@query("j12_known_faces", _MESH + " SELECT mesh_id, fid, a AS v0, b AS v1, c AS v2 FROM f WHERE a % 97 <> 96 AND b % 97 <> 96 AND c % 97 <> 96")
def j12(s, d):
    return M.without_unknown_vertices(*_mesh(s, d)).select("mesh_id", "fid", "v0", "v1", "v2")


@query("a17_mesh_centre_and_range", _MESH + " SELECT v.mesh_id, vid, round(2 * (x - mx), 6) AS x, round(2 * (y - my), 6) AS y, round(2 * (z - mz), 6) AS z, rx AS range_x, ry AS range_y, rz AS range_z FROM v JOIN (SELECT mesh_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, 2 * (max(x) - min(x)) AS rx, 2 * (max(y) - min(y)) AS ry, 2 * (max(z) - min(z)) AS rz FROM v GROUP BY 1) m ON v.mesh_id = m.mesh_id")
def a17(s, d):
    v = M.scaled(M.centred(_mesh(s, d)[0]), 2.0)
    e = M.extents(M.scaled(_mesh(s, d)[0], 2.0))
    return v.join(e, "mesh_id").select("mesh_id", "vid", *(F.round(c, 6).alias(c) for c in "xyz"), "range_x", "range_y", "range_z")


_NORM = """, e AS (SELECT f.*, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, r.x - p.x AS dx, r.y - p.y AS dy, r.z - p.z AS dz FROM f JOIN v p ON p.mesh_id = f.mesh_id AND p.vid = a JOIN v q ON q.mesh_id = f.mesh_id AND q.vid = b JOIN v r ON r.mesh_id = f.mesh_id AND r.vid = c),
n AS (SELECT mesh_id, a, b, c, ay * dz - az * dy AS x, az * dx - ax * dz AS y, ax * dy - ay * dx AS z FROM e), u AS (SELECT mesh_id, unnest([a, b, c]) AS vid, x / nullif(sqrt(x*x + y*y + z*z), 0) AS x, y / nullif(sqrt(x*x + y*y + z*z), 0) AS y, z / nullif(sqrt(x*x + y*y + z*z), 0) AS z FROM n),
t AS (SELECT mesh_id, vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM u GROUP BY 1, 2)
SELECT mesh_id, vid, round(x / nullif(sqrt(x*x + y*y + z*z), 0), 6) + 0 AS nx, round(y / nullif(sqrt(x*x + y*y + z*z), 0), 6) + 0 AS ny, round(z / nullif(sqrt(x*x + y*y + z*z), 0), 6) + 0 AS nz FROM t"""


@query("a18_vertex_normals", _MESH + _NORM)
def a18(s, d):
    n = M.vertex_normals(*_mesh(s, d))
    return n.select("mesh_id", "vid", *((F.round(c, 6) + 0).alias(c) for c in ("nx", "ny", "nz")))


@query("v16_iso_surface")
def v16(s, d):
    return M.iso_triangles(V.voxels(s, d), V.grids(s, d))


def reconstruct(s, d):
    """Blocks cut at the samples, placed back and averaged: the pipeline with the truth as its own oracle."""
    blocks = _blocks(s, d).join(D.cut_blocks(_blocks(s, d), V.voxels(s, d), V.grids(s, d), BLOCK, STEP), ["scene_id", "sample_id"])
    return R.average(D.place_predictions(blocks.withColumn("w", F.lit(1.0)), V.grids(s, d), BLOCK, STEP)).select(*CELL, "v", "n")


_PLACE = """, c1 AS (SELECT event_id, c.scene_id, c.i, c.j, c.k, s.x AS sx, s.y AS sy, s.z AS sz, floor((CASE WHEN event_id % 2 = 0 THEN c.y - s.y ELSE s.x - c.x END + 0.125) * 16) AS a, floor((CASE WHEN event_id % 2 = 0 THEN s.x - c.x ELSE s.y - c.y END + 0.125) * 16) AS b, floor((c.z - s.z + 0.125) * 16) AS e FROM samples s JOIN cells c ON s.scene_id = c.scene_id),
c2 AS (SELECT *, (a + 0.5) / 16 - 0.125 AS p, (b + 0.5) / 16 - 0.125 AS q, (e + 0.5) / 16 - 0.125 AS r FROM c1 WHERE a BETWEEN 0 AND 3 AND b BETWEEN 0 AND 3 AND e BETWEEN 0 AND 3),
c3 AS (SELECT scene_id, i AS ti, j AS tj, k AS tk, CAST(floor((sx - CASE WHEN event_id % 2 = 0 THEN q ELSE p END) * 16) AS INTEGER) AS i, CAST(floor((CASE WHEN event_id % 2 = 0 THEN sy + p ELSE sy - q END) * 16) AS INTEGER) AS j, CAST(floor((sz + r) * 16) AS INTEGER) AS k FROM c2)
SELECT scene_id, ti AS i, tj AS j, tk AS k, round(avg(v), 9) AS v, count(*) AS n FROM c3 JOIN voxels USING (scene_id, i, j, k) WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query("v13_oracle_reconstruction", W("samples", "voxels", "cells") + _PLACE)
def v13(s, d):
    return reconstruct(s, d).withColumn("v", F.round("v", 9))


def _split_blocks(s, d):
    """Blocks at the samples with their true values and masks: of the odd scenes to predict, of the even ones to learn from."""
    from voxelloom.plans import reconstruct as P

    blocks = _blocks(s, d)
    own = written(D.cut_blocks(blocks, V.voxels(s, d), V.grids(s, d), BLOCK, STEP, fill=V.MU, masked=True))
    return P, blocks, own.where("scene_id % 2 = 1"), own.where("scene_id % 2 = 0")


_NN = """, vals AS (SELECT w.scene_id, event_id, list(v ORDER BY lin) AS vals FROM w LEFT JOIN voxels USING (scene_id, i, j, k) GROUP BY 1, 2),
f AS (SELECT *, CAST(list_transform(vals, lambda x: coalesce(x, 0.25)) AS DOUBLE[64]) AS f FROM vals),
nn AS (SELECT q.event_id, min({'d': array_distance(q.f, t.f), 'id': t.event_id}).id AS nn_id FROM f q, f t WHERE q.scene_id % 2 = 1 AND t.scene_id % 2 = 0 GROUP BY 1),
p1 AS (SELECT event_id, c.scene_id, c.i, c.j, c.k, CAST(floor((CASE WHEN event_id % 2 = 0 THEN c.y - s.y ELSE s.x - c.x END + 0.125) * 16) AS INTEGER) AS a, CAST(floor((CASE WHEN event_id % 2 = 0 THEN s.x - c.x ELSE s.y - c.y END + 0.125) * 16) AS INTEGER) AS b, CAST(floor((c.z - s.z + 0.125) * 16) AS INTEGER) AS e FROM samples s JOIN cells c ON s.scene_id = c.scene_id WHERE s.scene_id % 2 = 1),
p2 AS (SELECT scene_id, i, j, k, vals[a * 16 + b * 4 + e + 1] AS v FROM (SELECT p1.*, f.vals FROM p1 JOIN nn ON nn.event_id = p1.event_id JOIN f ON f.event_id = nn.nn_id WHERE a BETWEEN 0 AND 3 AND b BETWEEN 0 AND 3 AND e BETWEEN 0 AND 3))
SELECT scene_id, i, j, k, round(avg(v), 9) AS v, CAST(count(v) AS DOUBLE) AS sum_w, count(*) AS n FROM p2 GROUP BY 1, 2, 3, 4"""


@query("v13_nn_oracle", W("samples", "voxels", "cells") + _BLOCKS + _NN)
def v13_nn(s, d):
    P, blocks, test, training = _split_blocks(s, d)
    placed = P.placed_back(P.nn_oracle(test, training), blocks, V.grids(s, d), BLOCK, STEP)
    return R.average(placed).select(*CELL, F.round("v", 9).alias("v"), "sum_w", "n")


@query("v13_coded_nn_oracle")
def v13_coded_nn(s, d):
    """The nearest neighbour among codes of a quarter of the components."""
    P, blocks, test, training = _split_blocks(s, d)
    places = blocks.select("scene_id", "sample_id", "rot", "origin")
    predicted = P.coded_nn_oracle(test.join(places, ["scene_id", "sample_id"]), P.Coded(training, "sample_id", 16))
    placed = D.place_predictions(predicted, V.grids(s, d), BLOCK, STEP)
    return R.average(placed).select(*CELL, F.round("v", 6).alias("v"), "n")


@query("v13_pca_oracle")
def v13_pca(s, d):
    P, blocks, test, training = _split_blocks(s, d)
    placed = P.placed_back(P.pca_oracle(test, training, 8), blocks, V.grids(s, d), BLOCK, STEP)
    return R.average(placed).select(*CELL, F.round("v", 6).alias("v"), "n")


#: Two models, each with its share of the samples: low blocks around the point, tall ones that stand on the floor.
MODELS = [("short", 0.5, BLOCK, None), ("tall", 0.5, (4, 4, 8), 0.25)]


@query("v12_reconstruction")
def v12(s, d):
    """What the frames show is the visible grid: features and comparisons come from it, blocks to learn from the truth of the
    even scenes. Each sample of the odd scenes has one model's forest choose its block; masks weigh the cells."""
    from voxelloom.operators import fusion as U
    from voxelloom.plans import reconstruct as P

    grids, truth, centre = V.grids(s, d), V.voxels(s, d), (0.5, 0.5, 0.5)
    visible = written(U.fuse_in_frustum(grids, V.frames(s, d), V.pixels(s, d), V.MU).where("v IS NOT NULL").select(*CELL, "v"))
    # Six steps read these two grids by tiles: their cells are rows only here, and those of the odd scenes' truth aren't read.
    seen_tiles = written(tiles.packed(visible))
    true_tiles = written(tiles.packed(truth.where("scene_id % 2 = 0").repartition("scene_id").sortWithinPartitions("scene_id")))
    samples = written(T.pick_model(_sampled_points(s, d), F.col("sample_id"), [(m, p) for m, p, _, _ in MODELS], 4))
    sums = []
    for model, _, shape, height in MODELS:
        blocks = P.sample_blocks(samples.where(F.col("model") == model), shape, STEP, centre, height)
        train, test = blocks.where("scene_id % 2 = 0"), blocks.where("scene_id % 2 = 1")
        x = written(P.ring_features(blocks, grids, seen_tiles, STEP, 2, -5.0))
        model_blocks = P.Coded(written(D.cut_blocks(train, true_tiles, grids, shape, STEP, fill=V.MU, masked=True)), "sample_id", 16)
        known = model_blocks.library.withColumnRenamed("medoid_id", "sample_id")
        rows = x.join(known, ["scene_id", "sample_id"]).select("scene_id", F.col("sample_id").alias("example_id"), "x", F.col("code").alias("y"))
        nodes = written(L.train_forest(T.bag_scenes(rows, 3, 0.5, BAG_ROWS, 9), model, tests=32, depth=5, pca_dims=16))
        seen = D.cut_blocks(test, seen_tiles, grids, shape, STEP)
        chosen = P.predict_model(test, x.join(test.select("sample_id"), "sample_id"), nodes, model_blocks, seen, "closest", "narrow_band", V.MU)
        sums.append(D.place_predictions(P.weights(chosen, 5.0), grids, shape, STEP))
    placed = written(sums[0].unionByName(sums[1]).groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("sum_v", "sum_w", "n"))))
    odd = lambda df: df.where("scene_id % 2 = 1")
    return P.fill_in(placed, odd(grids), odd(visible), V.MU, 2)
