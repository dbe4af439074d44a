"""Depth observations fused into signed-distance grids.

Whole grids are seen tile by tile. A tile is tested against a frame by the box of its cells' centres before any cell is made:
it is left out if all of the box is on the far side of one border of the image. What is left of a frame is cut into
bands of BAND_ROWS image rows, and a band's pixels, the camera and the numbers of the tiles that may fall in it meet in one
task, where the band is a plain array: depth is looked up by place, so that only pixels and tile numbers are shuffled, never a
row for each cell and frame. Such rows, or sums of a tile's cells over the frames, leave the task.

Points that lie behind a camera are projected like others unless asked otherwise. A frame has one row a pixel; rows outside
the image and unknown depths add nothing. Frames without a grid, or of a scene without frames, see nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import geometry as G
from voxelloom.operators import tiles as L
from voxelloom.operators.grid import CELL, evaluated, spread

FRAME = ["scene_id", "frame_id"]
BAND_ROWS = 64
#: Cells that a task projects at once.
SOME_CELLS = 1 << 15
_SIZES = ("ni", "nj", "nk", "h", "w")
_PARTS = {"rot": (3, 3), "origin": (3,), "intrinsics": (3, 3), "view": (3, 4)}
_VIEW = ["ni", "nj", "nk", "vox_size", "rot", "origin", "h", "w", "intrinsics", "view"]


def project_voxels(centres: DataFrame, frames: DataFrame, require_positive_depth: bool = False) -> DataFrame:
    """Pixel (row, col) and camera depth z of each of some points with a cell in each frame of its scene that sees it."""
    views = frames.select(*FRAME, "h", "w", F.col("k").alias("intrinsics"), G.inverse_pose(F.col("h_mat")).alias("view"))
    cam = G.to_camera(G.columns("x", "y", "z"), F.col("view"))
    joined = evaluated(centres.join(views, "scene_id"), **dict(zip(("cx", "cy", "cz"), cam, strict=True)))
    flat = G.mat3_apply(F.col("intrinsics"), G.columns("cx", "cy", "cz"))
    planar = evaluated(joined.select(*CELL, "frame_id", "h", "w", "intrinsics", "cx", "cy", "cz"), **dict(zip(("fu", "fv", "fz"), flat, strict=True)))
    pixel = {"col": G.snapped(F.try_divide("fu", "fz")), "row": G.snapped(F.try_divide("fv", "fz"))}
    seen = evaluated(planar.select(*CELL, "frame_id", "h", "w", "fu", "fv", "fz"), **pixel).select(*CELL, "frame_id", "h", "w", "col", "row", F.col("fz").alias("z"))
    inside = G.inside_image(F.col("col"), F.col("row"), F.col("w"), F.col("h"))
    if require_positive_depth:
        inside = inside & (F.col("z") > 0)
    return seen.where(inside).drop("h", "w")


def _flat(views: dict, idx: np.ndarray) -> np.ndarray:
    """Homogeneous pixel coordinates (fu, fv, fz) of places (m x 3) in the cells of a grid, in one frame or in each of some: n x m x 3."""
    world = ((idx + 0.5) * np.asarray(views["vox_size"])[..., None, None]) @ views["rot"].swapaxes(-1, -2) + views["origin"][..., None, :]
    camera = world @ views["view"][..., :3].swapaxes(-1, -2) + views["view"][..., None, :, 3]
    return camera @ views["intrinsics"].swapaxes(-1, -2)


def _tiles_in(views: dict, shape: tuple[int, ...], tile: int, band_rows: int) -> tuple[np.ndarray, ...]:
    """The tiles of a grid (ni, nj, nk) and, for some frames (h, w; a row each), whether a tile's cells may fall in it, and the first
    and last band of image rows that they may reach.

    With all corners of the box of centres in front (or all behind), a border of the image is a plane and the tile is out
    if every corner is beyond it; a pixel to spare covers rounding. Where the box crosses the camera's plane nothing is known.
    """
    *ends, h, w = shape
    n = -(-np.array(ends) // tile)
    boxes = np.stack(np.meshgrid(*map(np.arange, n), indexing="ij"), -1).reshape(-1, 3)
    low, high = boxes * tile, np.minimum((boxes + 1) * tile, ends) - 1
    pick = np.array(np.meshgrid(*[(0, 1)] * 3, indexing="ij")).reshape(3, -1).T
    corners = np.where(pick[None], high[:, None, :], low[:, None, :]).reshape(-1, 3)
    fu, fv, fz = (x.reshape(len(x), len(boxes), 8) for x in np.moveaxis(_flat(views, corners), -1, 0))
    side = np.where((fz > 0).all(2), 1.0, np.where((fz < 0).all(2), -1.0, 0.0))
    out = np.zeros(side.shape, bool)
    for f, size in ((fu, w), (fv, h)):
        for beyond in (-(f + 1.5 * fz), f - (size + 0.5) * fz):
            out |= (side != 0) & ((beyond * side[:, :, None]) > 0).all(2)
    last_band = (h - 1) // band_rows
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where((side != 0)[:, :, None], fv / fz, 0.0)
    first = np.where(side != 0, np.clip(np.floor((v.min(2) - 1) / band_rows), 0, last_band), 0).astype(int)
    last = np.where(side != 0, np.clip(np.floor((v.max(2) + 1) / band_rows), 0, last_band), last_band).astype(int)
    return boxes, ~out, first, last


def tile_bands(view: dict, tile: int, band_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tiles of a grid whose cells may fall in one frame, and the first and last band of image rows that they may reach."""
    one = {c: np.asarray(view[c], float)[None] for c in ("vox_size", "rot", "origin", "intrinsics", "view")}
    boxes, (use,), (first,), (last,) = _tiles_in(one, tuple(view[c] for c in ("ni", "nj", "nk", "h", "w")), tile, band_rows)
    return boxes[use], first[use], last[use]


def frame_bands(grids: DataFrame, frames: DataFrame, tile: int = L.TILE, band_rows: int = BAND_ROWS) -> DataFrame:
    """(scene_id, frame_id, band, camera and grid, tiles): the tiles that may fall in each band of each frame, as int triples."""
    pose = frames.select(*FRAME, "h", "w", F.col("k").alias("intrinsics"), G.inverse_pose(F.col("h_mat")).alias("view"))
    meta = grids.select("scene_id", *_VIEW[:6])
    rows = spread(pose.join(meta, "scene_id").select(*FRAME, *_VIEW), *FRAME)
    schema = rows.select("*", F.lit(0).alias("band"), F.lit(b"").alias("tiles")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch[c].to_numpy() for c in ("ni", "nj", "nk", "h", "w")], 1)
            for shape in map(tuple, np.unique(sizes, axis=0).tolist()):
                own = np.flatnonzero((sizes == shape).all(1))
                some = max(1, SOME_CELLS // (8 * int(np.prod([-(-n // tile) for n in shape[:3]]))))
                for begin in range(0, len(own), some):
                    yield reached(batch, own[begin : begin + some], shape)

    def reached(batch: pa.RecordBatch, own: np.ndarray, shape: tuple[int, ...]) -> pa.RecordBatch:
        boxes, *found = _tiles_in(_views(batch.take(pa.array(own))), shape, tile, band_rows)
        kinds, which = np.unique(np.concatenate(found, 1), axis=0, return_inverse=True)  # frames that see alike share their lists
        at, bands, tiles = [], [], []
        for kind, row in enumerate(kinds):
            use, first, last = np.split(row, 3)
            same = own[which.ravel() == kind]
            for band in range((shape[3] - 1) // band_rows + 1):
                hit = boxes[(use > 0) & (first <= band) & (band <= last)]
                if len(hit):
                    at.append(same)
                    bands.append(np.full(len(same), band, np.int32))
                    tiles += [hit.astype("<i4").tobytes()] * len(same)
        rows_of = batch.take(pa.array(np.concatenate([*at, np.zeros(0, int)])))
        return pa.RecordBatch.from_arrays([*rows_of.columns, pa.array(np.concatenate([*bands, np.zeros(0, np.int32)])), pa.array(tiles, pa.binary())], [*rows_of.schema.names, "band", "tiles"])

    return rows.mapInArrow(task, schema)


def _over_bands(grids: DataFrame, frames: DataFrame, pixels: DataFrame, sink: Callable, schema: str, tile: int, band_rows: int) -> DataFrame:
    """Bands with their pixels and tiles in one task each; `sink` makes what takes the cells seen and gives batches."""
    # Numbers travel as one column, as every pixel has a NULL in each of the others.
    packed = F.concat(F.array(*(F.col(c).cast("double") for c in (*_SIZES, "vox_size"))), *(F.col(c).cast("array<double>") for c in _PARTS)).alias("packed")
    views = frame_bands(grids, frames, tile, band_rows).select(*FRAME, "band", "tiles", packed, F.lit(False).alias("is_pixel"))
    own = pixels.where("depth IS NOT NULL").select(*FRAME, F.floor(F.col("row") / band_rows).cast("int").alias("band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("depth").cast("double").alias("depth"))
    keys = [*FRAME, "band"]
    rows = views.unionByName(own.withColumn("is_pixel", F.lit(True)), allowMissingColumns=True).withColumn("run", F.xxhash64(*keys))
    ordered = rows.repartition(*keys).sortWithinPartitions("run", *keys, "is_pixel")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sink()
        for batch in L.whole_runs(batches):
            is_pixel = batch["is_pixel"].to_numpy(zero_copy_only=False)
            new = ~is_pixel
            new[L.runs(batch["run"].to_numpy())] = True
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, batch.num_rows)) - 1
            use = ~is_pixel[start]  # pixels that no tile asks for are left out
            start, n = start[use], n[use]
            alike: dict[tuple, list[int]] = {}
            heads = batch.take(pa.array(start))
            camera = np.asarray(heads["packed"].flatten().to_numpy(zero_copy_only=False), float).reshape(len(start), -1)
            sizes = camera[:, : len(_SIZES)].astype(int).tolist()
            for at, (size, *key) in enumerate(zip(sizes, heads["band"].to_pylist(), heads["tiles"].to_pylist(), strict=True)):
                alike.setdefault((*size, *key), []).append(at)
            for (*numbers, tiles), own in alike.items():
                boxes = np.frombuffer(tiles, "<i4").reshape(-1, 3).astype(np.int64)
                shape = dict(zip(("ni", "nj", "nk", "h", "w", "band"), numbers, strict=True))
                cells = min(tile, shape["ni"]) * min(tile, shape["nj"]) * min(tile, shape["nk"])
                some = max(1, min(SOME_CELLS // max(1, cells), SOME_CELLS // max(1, band_rows * shape["w"])))
                for first in range(0, len(own), some):
                    part = np.array(own[first : first + some])
                    views = shape | _unpacked(heads.take(pa.array(part)), camera[part, len(_SIZES) :])
                    images = _bands(batch, start[part], n[part], shape, band_rows)
                    for box in boxes:
                        _look_up(views, box, images, tile, band_rows, out)
                        yield from out.ready()
        yield from out.rest()

    return ordered.mapInArrow(task, schema)


def _views(rows: pa.RecordBatch) -> dict:
    """Scenes, frames, cameras and grids of some bands as arrays."""
    cut = lambda c, shape: np.asarray(rows[c].flatten().to_numpy(zero_copy_only=False), float).reshape(rows.num_rows, *shape)
    return {"scene_id": rows["scene_id"], "frame_id": rows["frame_id"], "vox_size": rows["vox_size"].to_numpy()} | {c: cut(c, shape) for c, shape in _PARTS.items()}


def _unpacked(rows: pa.RecordBatch, camera: np.ndarray) -> dict:
    """The same from `vox_size` and the `_PARTS` end to end."""
    step, *parts = np.split(camera, np.cumsum([1, *(np.prod(shape) for shape in _PARTS.values())])[:-1], 1)
    named = {c: x.reshape(-1, *shape) for (c, shape), x in zip(_PARTS.items(), parts, strict=True)}
    return {"scene_id": rows["scene_id"], "frame_id": rows["frame_id"], "vox_size": step[:, 0]} | named


def _bands(batch: pa.RecordBatch, start: np.ndarray, n: np.ndarray, shape: dict, band_rows: int) -> np.ndarray:
    """The images of bands whose pixels follow the rows `start`, unknown pixels NaN."""
    which = np.repeat(np.arange(len(start)), n)
    at = pa.array(np.arange(len(which)) + np.repeat(start + 1 - np.cumsum(n) + n, n))
    row, col, depth = (batch[c].take(at).to_numpy() for c in ("row", "col", "depth"))
    images = np.full((len(start), band_rows, shape["w"]), np.nan)
    fits = (row >= 0) & (col >= 0) & (col < shape["w"]) & (row < shape["h"])
    images[which[fits], row[fits] - shape["band"] * band_rows, col[fits]] = depth[fits]
    return images


def _look_up(views: dict, box: np.ndarray, images: np.ndarray, tile: int, band_rows: int, out) -> None:
    """Cells of a tile that fall in some bands of one shape, with their pixel, camera depth and observed depth (NaN if unknown)."""
    sizes = np.minimum(np.array([views["ni"], views["nj"], views["nk"]]) - box * tile, tile)
    inner = np.stack(np.meshgrid(*map(np.arange, sizes), indexing="ij"), -1).reshape(-1, 3)
    lin = (inner[:, 0] * tile + inner[:, 1]) * tile + inner[:, 2]
    fu, fv, fz = np.moveaxis(_flat(views, box * tile + inner), -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        col, row = np.rint(fu / fz), np.rint(fv / fz)
    first = views["band"] * band_rows
    which, cell = np.nonzero((col >= 0) & (col < views["w"]) & (row >= first) & (row < min(first + band_rows, views["h"])) & (fz != 0))
    if len(which):
        col, row = col[which, cell].astype(np.int32), row[which, cell].astype(np.int32)
        out.take(views["scene_id"], views["frame_id"], which, tuple(box.tolist()), lin[cell], col, row, fz[which, cell], images[which, row - first, col])


class _Rows:
    """A row for each cell and frame."""

    def __init__(self, tile: int, scene: pa.DataType, frame: pa.DataType):
        self.tile, self.kinds, self.held = tile, (scene, frame), []

    def take(self, scenes, frames, which, box, lin, col, row, z, depth) -> None:
        ids = [x.take(pa.array(which)).cast(t) for x, t in zip((scenes, frames), self.kinds, strict=True)]
        ijk = L.tile_cells(box, lin, self.tile)
        self.held.append(pa.RecordBatch.from_arrays([ids[0], *map(pa.array, ijk), ids[1], *map(pa.array, (col, row, z)), pa.array(depth, mask=np.isnan(depth))], [*CELL, "frame_id", "col", "row", "z", "depth"]))

    def ready(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from pa.Table.from_batches(self.held).combine_chunks().to_batches()
            self.held = []

    rest = ready


class _Sums:
    """Sums of what `of(z, depth)` gives for each cell, a tile in one row."""

    def __init__(self, tile: int, scene: pa.DataType, n_sums: int, of: Callable):
        self.kind, self.of, self.sums = scene, of, L.TileSums(n_sums, tile)

    def take(self, scenes, frames, which, box, lin, col, row, z, depth) -> None:
        use, values = self.of(z, depth)
        if use.any():
            self.sums.add_some(scenes, which[use], box, lin[use], [v[use] for v in values])

    def ready(self) -> Iterator[pa.RecordBatch]:
        if self.sums.full():
            yield self.sums.batch(self.kind)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.sums.held:
            yield self.sums.batch(self.kind)


def _types(frames: DataFrame) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [frames.schema[c].dataType for c in FRAME]
    return [k.simpleString() for k in kinds], [to_arrow_type(k) for k in kinds]


def observe_grid(grids: DataFrame, frames: DataFrame, pixels: DataFrame, tile: int = L.TILE, band_rows: int = BAND_ROWS) -> DataFrame:
    """(cell, frame_id, col, row, z, depth): each cell of each grid in each frame that holds it; depth is NULL where unknown."""
    names, kinds = _types(frames)
    schema = f"scene_id {names[0]}, i int, j int, k int, frame_id {names[1]}, col int, row int, z double, depth double"
    return _over_bands(grids, frames, pixels, lambda: _Rows(tile, *kinds), schema, tile, band_rows)


def _sums_over(grids: DataFrame, frames: DataFrame, pixels: DataFrame, names: list[str], of: Callable, tile: int, band_rows: int, prior: DataFrame | None = None) -> DataFrame:
    scene, kinds = _types(frames)
    parts = _over_bands(grids, frames, pixels, lambda: _Sums(tile, kinds[0], len(names), of), L.sums_schema(scene[0]), tile, band_rows)
    return L.added(parts, names, tile, prior)


def _clipped(z: np.ndarray, depth: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    return z - depth, -np.clip(z - depth, -mu, mu)


def fuse_grid(grids: DataFrame, frames: DataFrame, pixels: DataFrame, mu: float, surface: float | None = None, narrow_band: bool = False, prior: DataFrame | None = None, tile: int = L.TILE, band_rows: int = BAND_ROWS) -> DataFrame:
    """Mean of the clipped distances to the observed surface of each cell, over the frames where it isn't hidden, as `fuse` has it.

    (cell, v, sum_w, visible, visible_count, n_frames) of the cells that are seen, or known in `prior`. A pixel mask is a filter
    of `pixels`.
    """
    limit = mu if surface is None else surface

    def of(z: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        distance, d = _clipped(z, depth, mu)
        near = np.abs(distance) <= mu if narrow_band else distance <= mu  # NaN is neither
        return near, [d, (np.abs(d) < limit).astype(float)]

    sums = _sums_over(grids, frames, pixels, ["sum_wd", "on_surface"], of, tile, band_rows, prior)
    w, wd = F.col("n").cast("double"), F.col("sum_wd")
    if prior is not None:
        w, wd = w + F.col("prior_n"), wd + F.col("prior_v")
    rows = sums.select(*CELL, w.alias("w"), wd.alias("wd"), F.col("on_surface").cast("long").alias("visible_count"), F.col("n").alias("n_frames"))
    return rows.select(*CELL, (F.col("wd") / F.col("w")).alias("v"), F.col("w").alias("sum_w"), (F.col("visible_count") > 0).alias("visible"), "visible_count", "n_frames")


def carve_grid(grids: DataFrame, frames: DataFrame, pixels: DataFrame, voxels: DataFrame, tile: int = L.TILE, band_rows: int = BAND_ROWS) -> DataFrame:
    """Value of each cell plus the number of frames that see past it."""
    empty = _sums_over(grids, frames, pixels, [], lambda z, depth: (depth > z, []), tile, band_rows)
    joined = voxels.join(empty, CELL, "left")
    return joined.select(*CELL, (F.coalesce("v", F.lit(0.0)) + F.coalesce("n", F.lit(0))).alias("v"))


def fuse_in_frustum(grids: DataFrame, frames: DataFrame, pixels: DataFrame, mu: float, tile: int = L.TILE, band_rows: int = BAND_ROWS) -> DataFrame:
    """Each cell that a frame's image holds: its fused distance `v` (NULL if hidden in all) and `in_frustum_count`.

    One projection serves both, as `fuse_grid` and `frustum_counts` have it.
    """

    def of(z: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        distance, d = _clipped(z, depth, mu)
        near = distance <= mu
        return np.ones(len(z), bool), [np.where(near, d, 0.0), near.astype(float)]

    sums = _sums_over(grids, frames, pixels, ["sum_d", "near"], of, tile, band_rows)
    return sums.select(*CELL, F.try_divide("sum_d", "near").alias("v"), F.col("n").alias("in_frustum_count"))


def observe(centres: DataFrame, frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """`project_voxels` of some points with the depth observed at the pixel; unseen depth drops the row.

    For few points, or pixels that arrive as a stream; `observe_grid` is for whole grids.
    """
    depth = pixels.where("depth IS NOT NULL").select(*FRAME, "row", "col", "depth")
    return project_voxels(centres, frames).join(depth, [*FRAME, "row", "col"])


def unseen_projection(voxels: DataFrame, frames: DataFrame) -> DataFrame:
    """Cells that aren't at the grid's largest value, or unknown, as pixels; coordinates are truncated.

    `voxels` has x, y, z. Frames are shuffled, as there are more of them than the size of the table that they come from tells.
    """
    top = voxels.groupBy("scene_id").agg(F.max("v").alias("top"))
    open_cells = voxels.join(top, "scene_id").where("v IS NULL OR v <> top")
    views = frames.select(*FRAME, F.col("k").alias("intrinsics"), G.inverse_pose(F.col("h_mat")).alias("view"))
    u, v, z = G.project(G.columns("x", "y", "z"), F.col("intrinsics"), F.col("view"))
    return open_cells.join(views.hint("merge"), "scene_id").select(*CELL, "frame_id", u.cast("int").alias("col"), v.cast("int").alias("row"), z.alias("z"))


def fuse(observed: DataFrame, mu: float, surface: float | None = None, narrow_band: bool = False, prior: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """Weighted mean of the clipped distances to the observed surface of each cell, over the frames where it isn't hidden.

    From rows of `observe` or `observe_grid`, where rows need weights of their own; `fuse_grid` sums in tiles. surface: largest
    clipped distance that counts as the surface itself, in world units. prior: a grid whose known cells start with weight 1.
    Sums don't depend on the order of frames.
    """
    distance = F.col("z") - F.col("depth")
    near = F.abs(distance) <= mu if narrow_band else distance <= mu
    d = -G.truncate(distance, mu)
    own = F.lit(1.0) if weight is None else weight
    limit = mu if surface is None else surface
    rows = observed.where(near).select(*CELL, own.alias("w"), (d * own).alias("wd"), (F.abs(d) < limit).alias("on_surface"), F.lit(1).alias("seen"))
    if prior is not None:
        known = prior.where("v IS NOT NULL")
        rows = rows.unionByName(known.select(*CELL, F.lit(1.0).alias("w"), F.col("v").alias("wd"), F.lit(False).alias("on_surface"), F.lit(0).alias("seen")))
    sums = rows.groupBy(*CELL).agg(F.sum("w").alias("sum_w"), F.sum("wd").alias("sum_wd"), F.max("on_surface").alias("visible"), F.count_if("on_surface").alias("visible_count"), F.sum("seen").alias("n_frames"))
    return sums.select(*CELL, (F.col("sum_wd") / F.col("sum_w")).alias("v"), "sum_w", "visible", "visible_count", "n_frames")


def frustum_counts(seen: DataFrame) -> DataFrame:
    """Frames whose image holds a cell, whether or not it is visible there, from rows of a projection."""
    return seen.groupBy(*CELL).agg(F.count("*").alias("in_frustum_count"))


def region_of(fused: DataFrame, least_k: int = 6) -> DataFrame:
    """The evaluation region among the rows of `fuse_in_frustum`: from `least_k` up, negative or unknown."""
    return fused.where((F.col("k") >= least_k) & (F.col("v").isNull() | (F.col("v") < 0)))


def evaluation_region(cells: DataFrame, visible: DataFrame, frustum: DataFrame, least_k: int = 6) -> DataFrame:
    """Cells in the frustum from `least_k` up whose visible distance is negative or unknown."""
    known = visible.select(*CELL, F.col("v"))
    inside = frustum.select(*CELL).distinct()
    return cells.select(*CELL).where(F.col("k") >= least_k).join(inside, CELL, "left_semi").join(known, CELL, "left").where("v IS NULL OR v < 0").select(*CELL)
