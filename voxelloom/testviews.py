"""Domain tables derived from the given star-schema tables, in Spark and, for the oracles, in SQL.

All values are dyadic, so sums are exact in any order and both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MU = 0.25
SHAPE = (16, 8, 12)
VOX = 1 / 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scene_id"), (F.col("l_partkey") % 16).cast("int").alias("i"), F.col("l_linenumber").alias("j"), (F.col("l_orderkey") % 12).cast("int").alias("k"))
    unknown = F.max(F.round(F.col("l_tax") * 100)) == 8
    return cells.agg(F.when(~unknown, (F.min("l_quantity") - 25) / 32).alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scene_id"), (F.col("l_linenumber") % 4).alias("frame_id"), (F.col("l_partkey") % 24).cast("int").alias("row"), (F.col("l_orderkey") % 32).cast("int").alias("col"))
    return cells.agg((F.min("l_quantity") / 32).alias("depth"), F.bool_or(F.col("l_returnflag") != "N").alias("mask"))


def doubles(*values: float):
    return F.array(*(F.lit(float(x)) for x in values))


def grids(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """16 x 8 x 12 cells of 1/16 at 0; `turned` by 90 degrees about z, moved so that it covers the same space."""
    rot, origin = (doubles(0, -1, 0, 1, 0, 0, 0, 0, 1), doubles(0.5, 0, 0)) if turned else (doubles(1, 0, 0, 0, 1, 0, 0, 0, 1), doubles(0, 0, 0))
    sizes = (8, 16, 12) if turned else SHAPE
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_id"), *(F.lit(n).alias(a) for a, n in zip(("ni", "nj", "nk"), sizes, strict=True)), F.lit(VOX).alias("vox_size"), origin.alias("origin"), rot.alias("rot"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of each scene along world x: camera x is world y, camera y is world z."""
    each = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("frame_id"))
    pose = F.array(*(F.lit(float(x)) for x in (0, 0, 1)), -0.5 - F.col("frame_id") / 8, *(F.lit(float(x)) for x in (1, 0, 0, 0.25, 0, 1, 0, 0.375, 0, 0, 0, 1)))
    return each.select("scene_id", "frame_id", F.lit(24).alias("h"), F.lit(32).alias("w"), doubles(32, 0, 16, 0, 32, 12, 0, 0, 1).alias("k"), pose.alias("h_mat"), F.lit(1.0).alias("depth_scaling"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: the first 32 numbers of an embedding are features, the last 32 targets, in steps of 1/1024."""
    e = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024) / 1024)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").alias("scene_id"), F.slice(e, 1, 32).alias("x"), F.slice(e, 33, 32).alias("y"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with normals from events; there are two scenes for three users, so a scene has about as many at every scale."""
    e = table(spark, sf_dir, "events")
    dyadic = lambda n, m, d: ((F.col("event_id") * n) % m).cast("double") / d
    return e.select("event_id", F.expr("user_id * 2 div 3").alias("scene_id"), dyadic(7, 64, 64).alias("x"), dyadic(11, 32, 64).alias("y"), dyadic(13, 48, 64).alias("z"), (dyadic(3, 9, 4) - 1).alias("nx"), (dyadic(5, 7, 4) - 0.75).alias("ny"), (dyadic(17, 5, 4) - 0.5).alias("nz"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table: test = nation's region, scene = customer segment and nation, from customers."""
    c = table(spark, sf_dir, "customer")
    rows = c.groupBy(F.concat(F.lit("test"), (F.col("c_nationkey") % 5).cast("string")).alias("test"), (F.col("c_nationkey") / 5).cast("int").alias("scene_id"))
    v = lambda n: (F.count_if(F.col("c_custkey") % n == 0) / 64).alias
    return rows.agg(v(3)("iou"), v(2)("precision"), v(5)("recall"))


SQL = {
    "voxels": "SELECT l_suppkey AS scene_id, CAST(l_partkey % 16 AS INTEGER) AS i, l_linenumber AS j, CAST(l_orderkey % 12 AS INTEGER) AS k, CASE WHEN max(round(l_tax * 100)) <> 8 THEN (min(l_quantity) - 25) / 32 END AS v FROM lineitem GROUP BY 1, 2, 3, 4",
    "pixels": "SELECT l_suppkey AS scene_id, l_linenumber % 4 AS frame_id, CAST(l_partkey % 24 AS INTEGER) AS \"row\", CAST(l_orderkey % 32 AS INTEGER) AS col, min(l_quantity) / 32 AS depth, bool_or(l_returnflag <> 'N') AS mask FROM lineitem GROUP BY 1, 2, 3, 4",
    "cells": "SELECT s_suppkey AS scene_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, (i + 0.5) / 16 AS x, (j + 0.5) / 16 AS y, (k + 0.5) / 16 AS z FROM supplier, range(16) a(i), range(8) b(j), range(12) c(k)",
    "projected": "SELECT scene_id, i, j, k, CAST(f AS INTEGER) AS frame_id, CAST(round_even(32 * (y - 0.25) / (x + 0.5 + f / 8) + 16, 0) AS INTEGER) AS col, CAST(round_even(32 * (z - 0.375) / (x + 0.5 + f / 8) + 12, 0) AS INTEGER) AS \"row\", x + 0.5 + f / 8 AS z FROM cells, range(4) g(f)",
    "seen": "SELECT * FROM projected WHERE col >= 0 AND col < 32 AND \"row\" >= 0 AND \"row\" < 24",
    "observed": "SELECT seen.*, depth FROM seen JOIN pixels USING (scene_id, frame_id, \"row\", col)",
    "fused": "SELECT scene_id, i, j, k, avg(-greatest(least(z - depth, 0.25), -0.25)) AS v, max(CASE WHEN abs(greatest(least(z - depth, 0.25), -0.25)) < 0.125 THEN 1 ELSE 0 END) AS on_surface, count(CASE WHEN abs(greatest(least(z - depth, 0.25), -0.25)) < 0.125 THEN 1 END) AS visible_count, count(*) AS n FROM observed WHERE z - depth <= 0.25 GROUP BY 1, 2, 3, 4",
    "examples": "SELECT vec_id AS example_id, label AS scene_id, list_transform(embedding[1:32], lambda e: floor(CAST(e AS DOUBLE) * 1024) / 1024) AS x, list_transform(embedding[33:64], lambda e: floor(CAST(e AS DOUBLE) * 1024) / 1024) AS y FROM embeddings",
    "samples": "SELECT event_id, user_id * 2 // 3 AS scene_id, (event_id * 7 % 64) / 64 AS x, (event_id * 11 % 32) / 64 AS y, (event_id * 13 % 48) / 64 AS z, (event_id * 3 % 9) / 4 - 1 AS nx, (event_id * 5 % 7) / 4 - 0.75 AS ny, (event_id * 17 % 5) / 4 - 0.5 AS nz FROM events",
    "scores": "SELECT 'test' || CAST(c_nationkey % 5 AS VARCHAR) AS test, CAST(trunc(c_nationkey / 5) AS INTEGER) AS scene_id, count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) / 64 AS iou, count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) / 64 AS \"precision\", count(CASE WHEN c_custkey % 5 = 0 THEN 1 END) / 64 AS recall FROM customer GROUP BY 1, 2",
}
_NEEDS = {"projected": ["cells"], "seen": ["projected"], "observed": ["seen", "pixels"], "fused": ["observed"]}


def with_views(*names: str) -> str:
    """WITH clause that defines the named views and those they need."""
    found: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in found:
            found.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in found)
