"""Connected components by alternating star contractions.

Each round points every node's larger neighbours, then itself and its smaller ones, at the smallest
neighbour, with one aggregation and one join; rounds grow with the logarithm of the longest path. No
neighbour list is gathered, and the links of a node with very many of them are dealt over many tasks. Rounds are
written to the shared folder, which cuts the lineage; a round's table goes when the next one is written.

Links with a null end, loops and repeated links add nothing; without links there are no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.skew import dealt_join, hot_keys
from voxelloom.llm.storage import new_folder, remove, written

#: Links of a node before they are dealt over several tasks.
HOT_NODE = 20_000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Both ways for the large star, from the larger end only for the small one."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    counted = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
    least = counted.select("u", F.least("u", "m").alias("m"))
    # A node with many links can only exist among many.
    joined = dealt_join(around, least, ["u"], hot_keys(counted, ["u"], "links", total, HOT_NODE), F.col("v")) if total > HOT_NODE else around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    links = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return links.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, below: str | None = None) -> DataFrame:
    """(node, label) with the smallest node of the component, for every node of (a, b) that isn't its own label.

    The result's table is in a folder of its own, or `below` one that the caller removes.
    """
    spark = edges.sparkSession
    place = lambda name: f"{below}/{name}-{uuid.uuid4().hex}" if below else new_folder(spark, name)
    folder = place("links")
    current = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links", folder)
    total = current.count()
    while total:
        next_folder = place("stars")
        new = written(_star(_star(current, True, total), False, total), "stars", next_folder)
        new_total = new.count()
        done = new_total == total and new.join(current, ["a", "b"], "left_anti").isEmpty()
        remove(spark, folder)
        current, total, folder = new, new_total, next_folder
        if done:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
