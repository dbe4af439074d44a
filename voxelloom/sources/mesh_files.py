"""OBJ and ASCII PLY meshes as text lines, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def obj_lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, line, value): whole files are split, so that lines keep their numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]*)\.obj$", 1).alias("mesh_id"), "value")
    return whole.select("mesh_id", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def parse_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid from 0, in file order) and faces (from 1-based numbers, texture and normal numbers dropped)."""
    parts = lines.select("mesh_id", "line", F.split(F.trim("value"), r"\s+").alias("p"))
    order = Window.partitionBy("mesh_id").orderBy("line")
    at = lambda kind: parts.where(F.col("p")[0] == kind).withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    vertices = at("v").select("mesh_id", F.col("n").alias("vid"), *(F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")))
    faces = at("f").select("mesh_id", F.col("n").alias("fid"), *((F.split(F.col("p")[k + 1], "/")[0].cast("long") - 1).alias(f"v{k}") for k in range(3)))
    return vertices, faces


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_obj(obj_lines(spark, path))


def _ordered(*parts: DataFrame) -> DataFrame:
    """(mesh_id, part, n, value) of headers, vertices and faces, in the order in which a file lists them."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("mesh_id", F.lit(k).alias("part"), "n", "value")
        out = p if out is None else out.unionByName(p)
    return out


def _dense(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("mesh_id").orderBy(key)) - 1)


def format_obj(vertices: DataFrame, faces: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Lines of OBJ files; a label (mesh_id, vid, label in [0, 1]) becomes a grey after the vertex."""
    v = _dense(vertices, "vid")
    number = v.select("mesh_id", "vid", (F.col("n") + 1).alias("at"))
    text = F.format_string("v %.4f %.4f %.4f", "x", "y", "z")
    if labels is not None:
        v = v.join(labels, ["mesh_id", "vid"], "left")
        grey = F.format_string(" %.4f", "label")
        text = F.when(F.col("label").isNull(), text).otherwise(F.concat(text, grey, grey, grey))
    rows = _dense(faces, "fid")
    for k in range(3):
        rows = rows.join(number.withColumnsRenamed({"vid": f"v{k}", "at": f"a{k}"}), ["mesh_id", f"v{k}"])
    return _ordered(v.select("mesh_id", "n", text.alias("value")), rows.select("mesh_id", "n", F.format_string("f %d %d %d", "a0", "a1", "a2").alias("value")))


def format_ply(vertices: DataFrame, faces: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Lines of ASCII PLY files, header first; labels as for `format_obj`, as grey bytes."""
    v, rows = _dense(vertices, "vid"), _dense(faces, "fid")
    number = v.select("mesh_id", "vid", F.col("n").alias("at"))
    sizes = v.groupBy("mesh_id").agg(F.count("*").alias("nv")).join(rows.groupBy("mesh_id").agg(F.count("*").alias("nf")), "mesh_id", "left")
    colour = ["property uchar red", "property uchar green", "property uchar blue"] if labels is not None else []
    head = F.array(
        F.lit("ply"),
        F.lit("format ascii 1.0"),
        F.concat(F.lit("element vertex "), F.col("nv").cast("string")),
        *(F.lit(f"property float {c}") for c in "xyz"),
        *map(F.lit, colour),
        F.concat(F.lit("element face "), F.coalesce("nf", F.lit(0)).cast("string")),
        F.lit("property list uchar int vertex_indices"),
        F.lit("end_header"),
    )
    text = F.format_string("%f %f %f", "x", "y", "z")
    if labels is not None:
        v = v.join(labels, ["mesh_id", "vid"], "left")
        grey = F.concat(F.lit(" "), F.round(F.coalesce("label", F.lit(0.0)) * 255).cast("int").cast("string"))
        text = F.concat(text, grey, grey, grey)
    for k in range(3):
        rows = rows.join(number.withColumnsRenamed({"vid": f"v{k}", "at": f"a{k}"}), ["mesh_id", f"v{k}"])
    return _ordered(
        sizes.select("mesh_id", F.posexplode(head).alias("n", "value")),
        v.select("mesh_id", "n", text.alias("value")),
        rows.select("mesh_id", "n", F.format_string("3 %d %d %d", "a0", "a1", "a2").alias("value")),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder for each mesh, its lines in order in one file."""
    ordered = lines.repartition("mesh_id").sortWithinPartitions("mesh_id", "part", "n")
    ordered.select("mesh_id", "value").write.partitionBy("mesh_id").text(path)
