"""Round trips through files and streams over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom import testviews as V
from voxelloom.functions import scalars as S
from voxelloom.operators import evaluate as E
from voxelloom.operators import grid as R
from voxelloom.operators import mesh as M
from voxelloom.plans.registry import query, shared_folder
from voxelloom.plans.scene_queries import _MESH, _mesh
from voxelloom.sources import files, grids_io, manifests, mesh_files, rasters, reports
from voxelloom.streaming import fusion as streams

CELL, W = R.CELL, V.with_views


@query("s1_s2_grid_dumps", W("voxels") + " SELECT * FROM voxels WHERE v IS NOT NULL")
def s1(s, d):
    """Dump and description of each scene written to its folder by slabs, and read back as ranges of bytes."""
    folder = shared_folder(s)
    grids_io.write_dumps(V.voxels(s, d), V.grids(s, d), folder)
    found = grids_io.read_dumps(s, folder, "truth", unknown="false")
    return found.select(F.col("scene_id").cast("long").alias("scene_id"), "i", "j", "k", "v")


_POSES = "SELECT CAST(s_suppkey AS VARCHAR) AS folder, CAST(f AS VARCHAR) AS frame_id, 'depth_' || CAST(f AS VARCHAR) || '.pgm' AS image, CAST([32, 0, 16, 0, 32, 12, 0, 0, 1] AS DOUBLE[]) AS k, CAST([0, 0, 1, -0.5 - f / 8, 1, 0, 0, 0.25, 0, 1, 0, 0.375, 0, 0, 0, 1] AS DOUBLE[]) AS h_mat, CAST(1 AS DOUBLE) AS depth_scaling FROM supplier, range(4) r(f)"


@query("s4_pose_files", _POSES)
def s4(s, d):
    """A pose file for each scene, and the frames as they are read from it."""
    folder = shared_folder(s)
    files.write_files(manifests.pose_files(V.frames(s, d), "depth_"), folder)
    return manifests.read_poses(s, f"{folder}/*/poses.yaml").select("folder", "frame_id", "image", "k", "h_mat", "depth_scaling")


@query("s6_frame_lists", "SELECT n_name || '_[' || CAST(f AS VARCHAR) || ']' AS name, n_name AS scene, [CAST(f AS INTEGER)] AS frames FROM nation, range(3) q(f)")
def s6(s, d):
    """A text file with the frame numbers of each scene, a line each, to one sequence a frame."""
    folder = shared_folder(s)
    n = V.table(s, d, "nation").select(F.concat("n_name", F.lit("/frames.txt")).alias("file"), F.encode(F.lit("0\n1\n2\n"), "utf-8").alias("content"))
    files.write_files(n, folder)
    return manifests.expand_frame_lists(s, f"{folder}/*/frames.txt")


@query("s2_grid_parquet", W("voxels") + " SELECT * FROM voxels")
def s2(s, d):
    path = f"{shared_folder(s)}/voxels"
    grids_io.write_grids(V.voxels(s, d), path)
    return s.read.schema("i int, j int, k int, v double, scene_id long").parquet(path).select(*CELL, "v")


@query("s3_depth_rasters", W("pixels") + " SELECT CAST(scene_id AS VARCHAR) || '/' || CAST(frame_id AS VARCHAR) AS file, \"row\", col, depth FROM pixels WHERE depth > 0")
def s3(s, d):
    coded = V.pixels(s, d).withColumn("raw", F.col("depth") * 32)
    folder = shared_folder(s)
    files.write_files(rasters.encode_rasters(coded, ["scene_id", "frame_id"], "raw", 24, 32), folder)
    found = rasters.read_rasters(s, f"{folder}/*/*", "raw")
    depth = S.decode_depth(F.col("raw"), 65536 / 32)
    return found.select("file", "row", "col", depth.alias("depth")).where("depth IS NOT NULL")


@query("s8_example_store", W("examples") + " SELECT example_id, scene_id, CASE WHEN example_id % 2 = 0 THEN 'short' ELSE 'tall' END AS block_type, x FROM examples")
def s8(s, d):
    path = f"{shared_folder(s)}/examples"
    e = V.examples(s, d).withColumn("block_type", F.when(F.col("example_id") % 2 == 0, "short").otherwise("tall"))
    grids_io.write_examples(e, path)
    manifest = e.select("scene_id").unionByName(s.range(900, 903).select(F.col("id").cast("int").alias("scene_id")))
    return grids_io.read_examples(s, path, manifest).select("example_id", "scene_id", "block_type", "x")


@query("s9_score_files", W("scores") + " SELECT * FROM scores")
def s9(s, d):
    path = f"{shared_folder(s)}/scores"
    reports.write_scores(V.scores(s, d), path)
    return s.read.schema("test string, scene_id int, iou double, precision double, recall double").json(path).select("test", "scene_id", "iou", "precision", "recall")


@query("s10_point_files", W("samples") + " SELECT scene_id, event_id, x, y FROM samples")
def s10(s, d):
    path = f"{shared_folder(s)}/points"
    reports.write_points(V.samples(s, d).select("scene_id", "event_id", "x", "y"), path)
    return s.read.csv(path, header=True, schema="scene_id long, event_id long, x double, y double").select("scene_id", "event_id", "x", "y")


@query("s11_usage_files", "SELECT 'm' || CAST(l_linenumber % 2 AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || ',' || CAST(count(*) AS VARCHAR) AS value FROM lineitem GROUP BY l_linenumber % 2, l_suppkey")
def s11(s, d):
    path = f"{shared_folder(s)}/counts"
    used = V.table(s, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("model"), F.col("l_suppkey").alias("medoid_id"))
    reports.count_lines(E.usage_counts(used), "model", "medoid_id", "n").write.text(path)
    return s.read.text(path)


def _known_mesh(s, d):
    """The known vertices, and the faces between them."""
    v, f = _mesh(s, d)
    return v.dropna(subset=["x", "y", "z"]), M.without_unknown_vertices(v, f)


@query("s12_obj_files", _MESH + " SELECT CAST(v.mesh_id AS VARCHAR) AS mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY vid) - 1 AS vid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM v WHERE x IS NOT NULL")
def s12(s, d):
    v, f = _known_mesh(s, d)
    path = f"{shared_folder(s)}/meshes"
    mesh_files.write_lines(mesh_files.format_obj(v, f), path)
    whole = s.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"mesh_id=([^/]*)/", 1).alias("mesh_id"), "value")
    vertices, _ = mesh_files.parse_obj(whole.select("mesh_id", F.posexplode(F.split("value", "\n")).alias("line", "value")))
    return vertices


@query("s13_ply_lines", _MESH + ", kv AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY vid) - 1 AS n FROM v WHERE x IS NOT NULL), kf AS (SELECT f.mesh_id, fid, p.n AS a, q.n AS b, r.n AS c FROM f JOIN kv p ON p.mesh_id = f.mesh_id AND p.vid = a JOIN kv q ON q.mesh_id = f.mesh_id AND q.vid = b JOIN kv r ON r.mesh_id = f.mesh_id AND r.vid = c), q AS (SELECT mesh_id, count(*) AS nv FROM kv GROUP BY 1), h AS (SELECT mesh_id, CAST(n AS INTEGER) AS n, ['ply', 'format ascii 1.0', 'element vertex ' || CAST(nv AS VARCHAR), 'property float x', 'property float y', 'property float z', 'element face ' || CAST((SELECT count(*) FROM kf WHERE kf.mesh_id = q.mesh_id) AS VARCHAR), 'property list uchar int vertex_indices', 'end_header'][n + 1] AS value FROM q, range(9) r(n)) SELECT mesh_id, 0 AS part, n, value FROM h UNION ALL SELECT mesh_id, 1, CAST(n AS INTEGER), format('{:.6f} {:.6f} {:.6f}', x, y, z) FROM kv UNION ALL SELECT mesh_id, 2, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY fid) - 1 AS INTEGER), '3 ' || CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR) || ' ' || CAST(c AS VARCHAR) FROM kf")
def s13(s, d):
    return mesh_files.format_ply(*_known_mesh(s, d))


def _stream(s: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """`df` as a stream of files, four of them, one a batch."""
    df.repartition(4).write.parquet(f"{folder}/in")
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query("r1_fusion_stream", W("fused") + " SELECT scene_id, i, j, k, round(v, 9) AS v, n AS sum_w FROM fused")
def r1(s, d):
    folder = shared_folder(s)
    stream = _stream(s, V.pixels(s, d), folder)
    fused = streams.fuse_stream(stream, V.grids(s, d), V.frames(s, d), V.MU)
    return streams.run_to_end(fused, folder).select(*CELL, F.round("v", 9).alias("v"), "sum_w")


@query("r2_accumulation_stream", "SELECT user_id % 10 AS scene_id, CAST(event_id % 16 AS INTEGER) AS i, CAST(event_id % 8 AS INTEGER) AS j, CAST(event_id % 12 AS INTEGER) AS k, sum(((event_id % 33) / 32 - 0.5) * ((event_id % 5) / 4)) AS sum_v, sum((event_id % 5) / 4) AS sum_w, count(*) AS n FROM events GROUP BY 1, 2, 3, 4")
def r2(s, d):
    folder, e = shared_folder(s), F.col("event_id")
    rows = V.table(s, d, "events").select((F.col("user_id") % 10).alias("scene_id"), (e % 16).cast("int").alias("i"), (e % 8).cast("int").alias("j"), (e % 12).cast("int").alias("k"), ((e % 33) / 32.0 - 0.5).alias("v"), ((e % 5) / 4.0).alias("w"))
    return streams.run_to_end(streams.accumulate_stream(_stream(s, rows, folder)), folder)
