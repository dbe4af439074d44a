"""Reproducible sampling: every draw is a function of a seed and a key, never of the partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.scalars import uniform

FRAME = ["scene_id", "frame_id"]
Hash = Callable[[Column, int], Column]


def weighted(pixels: DataFrame, weight: Column, n: int, seed: int, draw: Hash = uniform) -> DataFrame:
    """`n` draws with replacement a frame, in proportion to `weight` (unknown and negative ones count as 0).

    Rows are summed first and pixels inside their row, so that no frame is one window: a draw falls into a
    row's interval, then into a pixel's. Frames without weight have no draws; `frames_without_weight` lists them.
    """
    rows = pixels.select(*FRAME, "row", "col", F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)).alias("w")).where("w > 0")
    per_row = rows.groupBy(*FRAME, "row").agg(F.sum("w").alias("row_w"))
    down = Window.partitionBy(*FRAME).orderBy("row")
    per_row = per_row.withColumn("hi", F.sum("row_w").over(down)).withColumn("total", F.sum("row_w").over(Window.partitionBy(*FRAME)))
    draws = per_row.select(*FRAME, "total").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id"))
    draws = draws.withColumn("u", draw(F.xxhash64(*FRAME, "sample_id") if draw is uniform else F.col("scene_id") * 7919 + F.col("frame_id") * 104_729 + F.col("sample_id"), seed) * F.col("total"))
    in_row = draws.drop("total").join(per_row.select(*FRAME, "row", "hi", "row_w"), FRAME).where("u < hi AND u >= hi - row_w")
    right = Window.partitionBy(*FRAME, "row").orderBy("col")
    cells = rows.withColumn("cell_hi", F.sum("w").over(right))
    found = in_row.join(cells, [*FRAME, "row"]).where("u - (hi - row_w) < cell_hi AND u - (hi - row_w) >= cell_hi - w")
    return found.select(*FRAME, "sample_id", "row", "col")


def surface_weight(depth: Column, mask: Column, world_nz: Column, world_z: Column | None = None, label: Column | None = None, camera_nz: Column | None = None) -> Column:
    """Depth, but 0 off the mask and on upward surfaces; given the rest, also near the floor, without a label, and seen edge-on."""
    keep = mask & ~(world_nz > 0.98)
    if world_z is not None:
        keep = keep & ~(world_z < 0.035) & label.isNotNull() & ~(camera_nz > -0.1)
    return F.when(F.coalesce(keep, F.lit(False)), depth).otherwise(0.0)


def frames_without_weight(frames: DataFrame, drawn: DataFrame) -> DataFrame:
    return frames.select(*FRAME).join(drawn.select(*FRAME).distinct(), FRAME, "left_anti")


def uniform_in_mask(pixels: DataFrame, keep: Column, n: int, seed: int, draw: Hash = uniform) -> DataFrame:
    """`n` draws with replacement a frame, all kept pixels alike."""
    kept = pixels.where(keep).select(*FRAME, "row", "col")
    numbered = kept.withColumn("at", F.row_number().over(Window.partitionBy(*FRAME).orderBy("row", "col")) - 1)
    sizes = kept.groupBy(*FRAME).agg(F.count("*").alias("size"))
    draws = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id"))
    key = F.xxhash64(*FRAME, "sample_id") if draw is uniform else F.col("scene_id") * 7919 + F.col("frame_id") * 104_729 + F.col("sample_id")
    draws = draws.withColumn("at", F.floor(draw(key, seed) * F.col("size")).cast("int"))
    return draws.join(numbered, [*FRAME, "at"]).select(*FRAME, "sample_id", "row", "col")


def without_replacement(df: DataFrame, key: str, n: int, seed: int, draw: Hash = uniform) -> DataFrame:
    """`n` rows by the order of their hash: a top-n in each partition, no full sort."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


#: Ranges of hash values that rows are counted in, to find where a tree's cap falls.
RANK_BINS = 4096


def bag_scenes(examples: DataFrame, n_trees: int, fraction: float, cap: int, seed: int, draw: Hash = uniform) -> DataFrame:
    """For each tree a fraction of the scenes (rounded up), and of their rows the `cap` of the least hashes.

    Rows are counted a tree and range of hashes, which says the range that the cap falls into; rows of the ranges before stay
    where they lie, and only those of that one range are ranked.
    """
    scenes = examples.select("scene_id").distinct()
    trees = scenes.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"))
    ranked = trees.withColumn("r", F.row_number().over(Window.partitionBy("tree_id").orderBy(draw(F.col("scene_id") * 31 + F.col("tree_id"), seed), "scene_id")))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy("tree_id"))).where(F.col("r") <= F.ceil(F.col("n") * fraction))
    rows = examples.join(ranked.select("scene_id", "tree_id"), "scene_id")
    return least_hashes(rows, ["tree_id"], draw(F.col("example_id") * 37 + F.col("tree_id"), seed + 1), "example_id", cap)


def least_hashes(rows: DataFrame, group: list[str], rank: Column, key: str, cap: int, bins: int = RANK_BINS) -> DataFrame:
    """The `cap` rows of each group with the least `rank` (in [0, 1)), ties to the smaller key; groups are few."""
    binned = rows.withColumn("_rank", rank).withColumn("_bin", F.floor(F.col("_rank") * bins).cast("int"))
    counts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("_bin")))  # `bins` rows a group
    last = upto.where(F.col("upto") > cap).groupBy(*group).agg(F.min(F.struct("_bin", (F.lit(cap) - F.col("upto") + F.col("n")).alias("room"))).alias("last"))
    cut = binned.join(F.broadcast(last.select(*group, "last.*").withColumnRenamed("_bin", "_last")), group, "left")
    before = cut.where(F.col("_last").isNull() | (F.col("_bin") < F.col("_last")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_rank", key))
    within = cut.where(F.col("_bin") == F.col("_last")).withColumn("_place", place).where(F.col("_place") <= F.col("room")).drop("_place")
    return before.unionByName(within).drop("_rank", "_bin", "_last", "room")


def bag_rows(examples: DataFrame, n_trees: int, fraction: float, seed: int, draw: Hash = uniform) -> DataFrame:
    """For each tree a fraction of the rows, each by its own hash: no sort and no shuffle."""
    trees = examples.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"))
    return trees.where(draw(F.col("example_id") * 37 + F.col("tree_id"), seed) < fraction)


def out_of_bag(examples: DataFrame, bags: DataFrame, n_trees: int) -> DataFrame:
    """Rows that a tree didn't see."""
    trees = examples.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"))
    return trees.join(bags.select("tree_id", "example_id"), ["tree_id", "example_id"], "left_anti")


def pick_model(samples: DataFrame, key: Column, models: list[tuple[str, float]], seed: int, draw: Hash = uniform) -> DataFrame:
    """A model for each sample, by probability."""
    u, done, out = draw(key, seed), 0.0, F.lit(None).cast("string")
    picks = []
    for name, p in models:
        done += p
        picks.append((done, name))
    for limit, name in reversed(picks):
        out = F.when(u < limit, F.lit(name)).otherwise(out if limit != picks[-1][0] else F.lit(name))
    return samples.withColumn("model", out)


def first_n(manifest: DataFrame, order: list[str], n: int, partition: list[str] | None = None) -> DataFrame:
    """The first `n` rows of a manifest, in its own order, of each split."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    return manifest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
