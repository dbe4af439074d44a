"""Voxel grids as tables (scene_id, i, j, k, v); unknown is NULL or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import geometry as G
from voxelloom.operators import tiles as L

CELL = ["scene_id", "i", "j", "k"]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out before each becomes many, so that these aren't all made in the few tasks that read the rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with more columns, computed once: a generator keeps their expressions from being copied into every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def grid_cells(grids: DataFrame) -> DataFrame:
    """Every cell of every grid, with the grid's columns."""
    grids = spread(grids, "scene_id")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return grids.select("*", span("ni").alias("i")).select("*", span("nj").alias("j")).select("*", span("nk").alias("k"))


def _placed(df: DataFrame, *kept: str) -> DataFrame:
    world = G.idx_to_world(G.columns("i", "j", "k"), F.col("vox_size"), F.col("rot"), F.col("origin"))
    return df.select(*kept, *(c.alias(n) for c, n in zip(world, "xyz", strict=True)))


def world_centres(grids: DataFrame) -> DataFrame:
    """Every cell with its world centre (meshgrid)."""
    return _placed(grid_cells(grids), *CELL)


def centres_of(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """The given cells that lie in their scene's grid, with all their columns and their world centres; no other cell is made."""
    meta = grids.select("scene_id", "ni", "nj", "nk", "vox_size", "rot", "origin")
    inside = G.in_bounds(G.columns("i", "j", "k"), G.columns("ni", "nj", "nk"))
    return _placed(cells.join(meta, "scene_id").where(inside), *cells.columns)


def column_centres(grids: DataFrame) -> DataFrame:
    """World centres of the slice k = 0: one row for each column of cells."""
    return world_centres(grids.withColumn("nk", F.lit(1)))


def slice_heights(grids: DataFrame) -> DataFrame:
    """World z of each slice of an upright grid."""
    return world_centres(grids.withColumn("ni", F.lit(1)).withColumn("nj", F.lit(1))).select("scene_id", "k", "z")


def corners(grids: DataFrame) -> DataFrame:
    """The eight corners of each grid in world space."""
    eight = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1))))
    each = grids.select("*", eight.alias("e"))
    at = each.select("*", *((F.col(f"e.{e}") * F.col(n)).cast("double").alias(i) for e, n, i in zip("abc", ("ni", "nj", "nk"), "ijk", strict=True)))
    world = G.idx_to_world([c - 0.5 for c in G.columns("i", "j", "k")], F.col("vox_size"), F.col("rot"), F.col("origin"))
    return at.select("scene_id", *(F.col(c).cast("int").alias(c) for c in "ijk"), *(c.alias(n) for c, n in zip(world, "xyz", strict=True)))


def locate(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Cell (i, j, k) of each point (x, y, z) in its scene's grid, and whether it lies inside."""
    shape = grids.select("scene_id", "ni", "nj", "nk", "vox_size", "rot", "origin")
    found = points.join(shape, "scene_id")
    idx = G.world_to_idx(G.columns("x", "y", "z"), F.col("vox_size"), F.col("rot"), F.col("origin"))
    return found.select(*points.columns, "ni", "nj", "nk", *(c.alias(n) for c, n in zip(idx, "ijk", strict=True))).withColumn("inside", G.in_bounds(G.columns("i", "j", "k"), G.columns("ni", "nj", "nk"))).drop("ni", "nj", "nk")


def lookup(points: DataFrame, voxels: DataFrame, only_hits: bool = False) -> DataFrame:
    """`v` of each row's cell; NULL outside, or the row is left out."""
    return points.join(voxels.select(*CELL, "v"), CELL, "inner" if only_hits else "left")


def set_where(voxels: DataFrame, condition: Column, value: Column) -> DataFrame:
    return voxels.withColumn("v", F.when(condition, value).otherwise(F.col("v")))


def update(voxels: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells of `updates` (with `seq` and `value`) get the value of the largest seq, ties to the larger value; others stay."""
    last = updates.groupBy(*CELL).agg(F.max(F.struct("seq", "value")).alias("last"))
    joined = voxels.join(last, CELL, "left")
    return joined.select(*CELL, F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col("v")).alias("v"))


def resample(target: DataFrame, target_voxels: DataFrame, source_grid: DataFrame, source_voxels: DataFrame, mode: str = "replace") -> DataFrame:
    """Values of the source grid at the target's cell centres.

    replace: a known source value wins; sum: known values add; accumulator: also counts what was added.
    """
    at = locate(_placed(grid_cells(target), *CELL).select("scene_id", F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("k").alias("tk"), "x", "y", "z"), source_grid).where("inside")
    hits = lookup(at, source_voxels, only_hits=True).where("v IS NOT NULL").select("scene_id", F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), F.col("v").alias("new"))
    joined = target_voxels.select(*CELL, "v").join(hits, CELL, "left")
    if mode == "replace":
        return joined.select(*CELL, F.coalesce("new", "v").alias("v"))
    summed = F.when(F.col("new").isNotNull(), F.coalesce("v", F.lit(0.0)) + F.col("new")).otherwise(F.col("v"))
    if mode == "sum":
        return joined.select(*CELL, summed.alias("v"))
    return joined.select(*CELL, summed.alias("v"), F.col("new").isNotNull().cast("int").alias("n"))


def resample_upright(target: DataFrame, source_grid: DataFrame, source_voxels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Source values at the target's cells where both are upright: cells map once a column and once a slice.

    With `weights`, a grid like the source (unknown and absent ones 0), also the weight `w` of each value and an explicit
    count `n` of 1, so that `accumulate` sums them as it does predictions.
    """
    columns = locate(column_centres(target).withColumnRenamed("k", "k0").select("scene_id", F.col("i").alias("ti"), F.col("j").alias("tj"), "x", "y", "z"), source_grid)
    columns = columns.select("scene_id", "ti", "tj", "i", "j")
    slices = slice_heights(target).select("scene_id", F.col("k").alias("tk"), "z")
    sg = source_grid.select("scene_id", F.col("vox_size").alias("s"), F.col("origin")[2].alias("z0"), F.col("nk").alias("n"))
    slices = slices.join(sg, "scene_id").select("scene_id", "tk", F.floor((F.col("z") - F.col("z0")) / F.col("s")).cast("int").alias("k"))
    kept = ["v"] if weights is None else ["v", "w", "n"]
    if weights is not None:
        weighed = source_voxels.select(*CELL, "v").join(weights.select(*CELL, F.col("v").alias("w")), CELL, "left")
        source_voxels = weighed.withColumns({"w": F.coalesce("w", F.lit(0.0)), "n": F.lit(1)})
    known = source_voxels.where("v IS NOT NULL").join(columns, ["scene_id", "i", "j"]).join(slices, ["scene_id", "k"])
    return known.select("scene_id", F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), *kept)


def keep_existing(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Observed values where known, predictions elsewhere."""
    p = predicted.select(*CELL, F.col("v").alias("p"))
    return observed.select(*CELL, "v").join(p, CELL, "full").select(*CELL, F.coalesce("v", "p").alias("v"))


def without_excess(v: Column, seen: Column, mu: float) -> Column:
    return F.when(seen > 0, mu).otherwise(F.coalesce(v, F.lit(mu)))


def remove_excess(prediction: DataFrame, observed: DataFrame, mu: float) -> DataFrame:
    """+mu where the observed grid is empty, and where the prediction is unknown."""
    seen = observed.select(*CELL, F.col("v").alias("seen"))
    joined = prediction.select(*CELL, "v").join(seen, CELL, "left")
    return joined.select(*CELL, without_excess(F.col("v"), F.col("seen"), mu).alias("v"))


def accumulate(values: DataFrame, below: Column | None = None) -> DataFrame:
    """Sums over (cell, v, w): weighted sum, sum of weights, count. `below` keeps predictions that are no empty space."""
    rows = values if below is None else values.where(below)
    return rows.groupBy(*CELL).agg(F.sum(F.col("v") * F.col("w")).alias("sum_v"), F.sum("w").alias("sum_w"), F.count("v").alias("n"))


def average(accumulated: DataFrame) -> DataFrame:
    return accumulated.withColumn("v", F.when(F.col("sum_w") != 0, F.col("sum_v") / F.col("sum_w")))


def least_evidence(averaged: DataFrame, least: int, mu: float) -> DataFrame:
    """+mu where fewer than `least` predictions (or less weight, where no count was kept) reached a cell."""
    return averaged.withColumn("v", F.when(F.coalesce(F.col("n").cast("double"), F.col("sum_w")) < least, mu).otherwise(F.col("v")))


def occupied_above(voxels: DataFrame, floor_k: int, threshold: int) -> DataFrame:
    """Columns with more than `threshold` solid cells from `floor_k` up."""
    counts = voxels.where(F.col("k") >= floor_k).groupBy("scene_id", "i", "j").agg(F.count_if(F.col("v") < 0).alias("n"))
    return counts.withColumn("occupied", F.col("n") > threshold)


def top_view(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("scene_id", "i", "j").agg(F.avg("v").alias("mean_v"))


def distinct_labels(labels: DataFrame) -> DataFrame:
    return labels.select("scene_id", "label").distinct()


def occupancy(indices: DataFrame) -> DataFrame:
    """Distinct cells of a list of indices, with the size of the grid that just holds them."""
    cells = indices.select(*CELL).distinct()
    size = cells.groupBy("scene_id").agg(*((F.max(a) + 1).alias(f"n{a}") for a in "ijk"))
    return cells.join(size, "scene_id")


def label_copies(voxels: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The grid once for each wanted (scene_id, idx), unknown where another label owns the cell."""
    both = voxels.join(labels, CELL).join(wanted, "scene_id")
    return both.select("idx", *CELL, F.when(F.col("label").isin(0) | (F.col("label") == F.col("idx")), F.col("v")).alias("v"))


def flattened_down(labels: DataFrame) -> DataFrame:
    """Region of each label: every cell with that label at or above it."""
    own = labels.where("label > 0").groupBy("scene_id", "i", "j", F.col("label").alias("idx")).agg(F.max("k").alias("top"))
    return own.select("scene_id", "idx", "i", "j", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("k"))


def _differences(near: Column, least: Column) -> list[Column]:
    """Unit vector of the differences between the first three and the last three values, unknown ones as the grid's least."""
    d = [F.coalesce(near[n], least) - F.coalesce(near[n + 3], least) for n in range(3)]
    length = F.when(G.norm(d) == 0, 1e-4).otherwise(G.norm(d))
    return [c / length for c in d]


def _steps(reach: int) -> list[tuple[int, int, int]]:
    ahead = [(reach, 0, 0), (0, reach, 0), (0, 0, reach)]
    return ahead + [tuple(-x for x in s) for s in ahead]


def voxel_normals(voxels: DataFrame, grids: DataFrame, reach: int = 3) -> DataFrame:
    """Normals of the cells from differences over `reach` cells either way, indices clamped, unknown and absent cells as the
    grid's least value."""
    least = voxels.groupBy("scene_id").agg(F.min("v").alias("least"))
    found = L.neighbours(voxels.select(*CELL), voxels, grids, _steps(reach)).join(least, "scene_id")
    return found.select(*CELL, *(c.alias(n) for c, n in zip(_differences(F.col("near"), F.col("least")), ("nx", "ny", "nz"), strict=True)))


def pixel_normals(pixels: DataFrame, frames: DataFrame, voxels: DataFrame, grids: DataFrame, reach: int = 3) -> DataFrame:
    """(scene_id, frame_id, row, col, nx, ny, nz): normals of the grid at the masked pixels' surface points, in the image's frame.

    The differences of `voxel_normals` at the cell that holds the point, turned by the rotation of the frame's inverse pose.
    Pixels off the mask have the normal 0, masked ones of unknown depth or of a scene without a grid NULL.
    """
    frame = ["scene_id", "frame_id"]
    camera = frames.select(*frame, F.col("k").alias("intrinsics"), "h_mat")
    own = pixels.where(F.col("mask") & F.col("depth").isNotNull()).select(*frame, "row", "col", "depth").join(camera, frame)
    cam = G.unproject_camera(F.col("col"), F.col("row"), F.col("depth"), F.col("intrinsics"))
    placed = evaluated(own, **dict(zip(("cx", "cy", "cz"), cam, strict=True)))
    world = [c.alias(n) for c, n in zip(G.camera_to_world(G.columns("cx", "cy", "cz"), F.col("h_mat")), "xyz", strict=True)]
    points = locate(placed.select(*frame, "row", "col", *world), grids).select(*frame, "row", "col", "i", "j", "k")
    least = voxels.groupBy("scene_id").agg(F.min("v").alias("least"))
    turned = frames.select(*frame, G.inverse_pose(F.col("h_mat")).alias("view"))
    found = L.neighbours(points, voxels, grids, _steps(reach)).join(least, "scene_id").join(turned, frame)
    d = _differences(F.col("near"), F.col("least"))
    normal = [F.col("view")[4 * r] * d[0] + F.col("view")[4 * r + 1] * d[1] + F.col("view")[4 * r + 2] * d[2] for r in range(3)]
    names = ("nx", "ny", "nz")
    known = found.select(*frame, "row", "col", *(c.alias(n) for c, n in zip(normal, names, strict=True)))
    every = pixels.select(*frame, "row", "col", F.coalesce("mask", F.lit(False)).alias("mask")).join(known, [*frame, "row", "col"], "left")
    return every.select(*frame, "row", "col", *(F.when(F.col("mask"), F.col(n)).otherwise(0.0).alias(n) for n in names))


def pack(voxels: DataFrame, tile: int) -> DataFrame:
    """Tiles of `tile`^3 cells as arrays in C order, absent cells NULL."""
    at = voxels.select("scene_id", *(F.floor(F.col(a) / tile).cast("int").alias(f"b{a}") for a in "ijk"), ((F.col("i") % tile * tile + F.col("j") % tile) * tile + F.col("k") % tile).alias("lin"), "v")
    cells = at.groupBy("scene_id", "bi", "bj", "bk").agg(F.map_from_entries(F.collect_list(F.struct("lin", "v"))).alias("m"))
    return cells.select("scene_id", "bi", "bj", "bk", F.transform(F.sequence(F.lit(0), F.lit(tile**3 - 1)), lambda x: F.try_element_at(F.col("m"), x)).alias("vals"))


def unpack(blocks: DataFrame, tile: int) -> DataFrame:
    cells = blocks.select("scene_id", "bi", "bj", "bk", F.posexplode("vals").alias("lin", "v")).where("v IS NOT NULL")
    return cells.select("scene_id", (F.col("bi") * tile + F.floor(F.col("lin") / (tile * tile))).cast("int").alias("i"), (F.col("bj") * tile + F.floor(F.col("lin") / tile) % tile).cast("int").alias("j"), (F.col("bk") * tile + F.col("lin") % tile).cast("int").alias("k"), "v")
