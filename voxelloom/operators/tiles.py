"""Sums over the cells of a tile of a grid as arrays: made in tasks, shuffled as one row a tile, added by tile.

A tile is `TILE`^3 cells of a scene's grid, (bi, bj, bk) its place among tiles and `lin` the C-order place of a cell in it.
Operators that reach many cells many times (fusion, placed predictions) add in a task what falls in a tile, and only
sums leave it: as many rows as tiles and tasks, however many cells, frames or predictions there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 16
BOX = ["scene_id", "bi", "bj", "bk"]
#: Tiles that a task adds to before it sends them on.
HELD_TILES = 512


class TileSums:
    """Some sums a cell for the tiles that a task has reached, at most HELD_TILES of them at once."""

    def __init__(self, n_sums: int, tile: int = TILE):
        self.n_sums, self.tile, self.held = n_sums, tile, {}

    def add(self, scene, box: tuple[int, int, int], lin: np.ndarray, values: Sequence[np.ndarray]) -> None:
        key, cells = (scene, *box), self.tile**3
        if key not in self.held:
            self.held[key] = np.zeros((self.n_sums + 1, cells))
        own = self.held[key]
        own[0] += np.bincount(lin, minlength=cells)
        for k, v in enumerate(values):
            own[k + 1] += np.bincount(lin, v, cells)

    def add_some(self, scenes: pa.Array, which: np.ndarray, box: tuple[int, int, int], lin: np.ndarray, values: Sequence[np.ndarray]) -> None:
        """`add` for the same tile of some scenes; a value is of the scene `scenes[which]`."""
        coded = scenes.dictionary_encode()
        names, cells = coded.dictionary.to_pylist(), self.tile**3
        at = coded.indices.to_numpy().astype(np.int64)[which] * cells + lin
        sums = np.stack([np.bincount(at, v, len(names) * cells).reshape(-1, cells) for v in (None, *values)], 1)
        for n in np.unique(at // cells).tolist():
            key = (names[n], *box)
            self.held[key] = self.held[key] + sums[n] if key in self.held else sums[n].astype(float)

    def full(self) -> bool:
        return len(self.held) >= HELD_TILES

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """The sums of each tile as one array of (reached cells x (n_sums + 1)) doubles, emptied here."""
        rows = []
        for key, own in self.held.items():
            lin = np.flatnonzero(own[0])
            rows.append((*key, lin.astype("<i4").tobytes(), np.ascontiguousarray(own[:, lin]).tobytes()))
        self.held = {}
        kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*BOX, "lin", "sums"])


def sums_schema(scene_type: str) -> str:
    return f"scene_id {scene_type}, bi int, bj int, bk int, lin binary, sums binary"


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted columns begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


#: Rows of small groups that a task works on at once.
SOME_ROWS = 1 << 16


def whole_runs(batches: Iterator[pa.RecordBatch], some: int = SOME_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches sorted by `run` as batches of about `some` rows that end where a run ends, so that small groups share the cost of
    a call and of its array operations; a large group comes alone."""
    held, n, wanted = [], 0, some
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < wanted:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cut = int(runs(whole["run"].to_numpy())[-1])
        if cut:
            yield whole.slice(0, cut)
        held, n = [whole.slice(cut)], whole.num_rows - cut
        wanted = max(some, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a column of lists, NaN as NULL."""
    flat = np.ascontiguousarray(rows, np.float64).ravel()
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1], pa.array(flat, mask=np.isnan(flat)))


def spans(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """An array cut at some places as a column of binaries."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def packed(voxels: DataFrame, tile: int = TILE) -> DataFrame:
    """The known cells of grids as (scene_id, bi, bj, bk, cells, values): some cells of a tile and what they hold, as binaries.

    A batch's cells of a tile are a row, so cells that come scene by scene make few rows; a tile may have several. Where
    several steps read a grid by tiles, its cells are rows once only.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch["scene_id"].dictionary_encode().indices.to_numpy()
            ijk = [batch[c].to_numpy() for c in "ijk"]
            box = [x // tile for x in ijk]
            lin = (ijk[0] % tile * tile + ijk[1] % tile) * tile + ijk[2] % tile
            order = np.lexsort((*box[::-1], coded))
            first = runs(*(x[order] for x in (coded, *box)))
            cuts = np.append(first, len(order))
            raw = [spans(lin[order].astype("<i4"), cuts), spans(batch["v"].to_numpy()[order].astype("<f8"), cuts)]
            at = order[first]
            yield pa.RecordBatch.from_arrays([batch["scene_id"].take(pa.array(at)), *(pa.array(x[at].astype(np.int32)) for x in box), *raw], [*BOX, "cells", "values"])

    known = voxels.where("v IS NOT NULL").select("scene_id", "i", "j", "k", F.col("v").cast("double").alias("v"))
    return known.mapInArrow(task, f"scene_id {voxels.schema['scene_id'].dataType.simpleString()}, bi int, bj int, bk int, cells binary, values binary")


def tile_cells(box: tuple[int, int, int], lin: np.ndarray, tile: int = TILE) -> list[np.ndarray]:
    """i, j, k of places in a tile."""
    return [(b * tile + x).astype(np.int32) for b, x in zip(box, (lin // (tile * tile), lin // tile % tile, lin % tile), strict=True)]


#: Tiles that a task adds up at once.
SOME_TILES = 128


def added(parts: DataFrame, names: Sequence[str], tile: int = TILE, prior: DataFrame | None = None) -> DataFrame:
    """(cell, n, the named sums) of tile sums: a tile's rows meet in one task and are added as arrays, some tiles at a time.

    With a grid as `prior` its known cells meet the tile too: also `prior_n` and `prior_v`, how many there are and their sum.
    """
    scene = parts.schema["scene_id"].dataType.simpleString()
    rows, more = parts, []
    if prior is not None:
        at = [F.floor(F.col(c) / tile).cast("int").alias(b) for c, b in zip("ijk", BOX[1:], strict=True)]
        lin = ((F.pmod("i", F.lit(tile)) * tile + F.pmod("j", F.lit(tile))) * tile + F.pmod("k", F.lit(tile))).cast("int").alias("at")
        known = prior.where("v IS NOT NULL").select(F.col("scene_id").cast(scene).alias("scene_id"), *at, lin, F.col("v").cast("double").alias("v"))
        rows, more = parts.unionByName(known, allowMissingColumns=True), ["prior_n", "prior_v"]
    n_sums, cells = len(names) + 1, tile**3

    def some_tiles(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        raw = [batch[c].fill_null(b"") for c in ("lin", "sums")]
        lin, flat = np.frombuffer(b"".join(raw[0].to_pylist()), "<i4"), np.frombuffer(b"".join(raw[1].to_pylist()))
        n = pc.binary_length(raw[0]).to_numpy().astype(np.int64) // 4
        before = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        place = n_sums * before[row] + np.arange(len(row)) - before[row]  # a row's sums lie behind each other, each of its cells
        key = of[row] * cells + lin
        total = [np.bincount(key, flat[place + k * n[row]], len(starts) * cells) for k in range(n_sums)]
        if more:
            own = batch["at"].is_valid().to_numpy(zero_copy_only=False)
            key = of[own] * cells + batch["at"].fill_null(0).to_numpy()[own]
            total += [np.bincount(key, w, len(starts) * cells) for w in (None, batch["v"].fill_null(0).to_numpy()[own])]
        reached = np.flatnonzero(total[0] + total[-2] if more else total[0])
        own, at = np.divmod(reached, cells)
        which = starts[own]
        ijk = [batch[b].to_numpy()[which] * tile + x for b, x in zip(BOX[1:], (at // (tile * tile), at // tile % tile, at % tile), strict=True)]
        columns = [batch["scene_id"].take(pa.array(which)), *(pa.array(x.astype(np.int32)) for x in ijk), pa.array(total[0][reached].astype(np.int64)), *(pa.array(x[reached].astype(float)) for x in total[1:])]
        return pa.RecordBatch.from_arrays(columns, ["scene_id", "i", "j", "k", "n", *names, *more])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 1 << 11 if not more else 1 << 15):
            box = [batch[c].to_numpy(zero_copy_only=False) for c in BOX]
            starts = runs(*box)
            ends = np.append(starts[1:], batch.num_rows)
            for first in range(0, len(starts), SOME_TILES):
                own = starts[first : first + SOME_TILES]
                yield some_tiles(batch.slice(own[0], ends[min(first + SOME_TILES, len(starts)) - 1] - own[0]), own - own[0])

    ordered = rows.withColumn("run", F.xxhash64(*BOX)).repartition(*BOX).sortWithinPartitions("run", *BOX)
    return ordered.mapInArrow(task, f"scene_id {scene}, i int, j int, k int, n long" + "".join(f", {n} double" for n in [*names, *more]))


def neighbours(points: DataFrame, voxels: DataFrame, grids: DataFrame, offsets: Sequence[tuple[int, int, int]], tile: int = TILE) -> DataFrame:
    """`points` (with scene_id and a cell i, j, k, inside their grid or not) and `near`: the values at some offsets from the cell.

    Indices are clamped to the grid; unknown and absent cells are NULL. Tiles carry a halo, as many cells of their neighbours as
    an offset reaches, so that a point meets one tile only: the tile's cells come first in a task and the points that lie in it
    follow. Points of scenes without a grid are left out.
    """
    reach = int(np.abs(np.array(offsets)).max(initial=0))
    wide, shift = tile + 2 * reach, np.array(offsets)
    at = lambda a, step: F.floor((F.col(a) + step) / tile).cast("int")
    sides = [F.explode(F.sequence(at(a, -reach), at(a, reach))).alias(b) for a, b in zip("ijk", BOX[1:], strict=True)]
    cells = voxels.where("v IS NOT NULL").select("scene_id", "i", "j", "k", F.col("v").cast("double").alias("v"))
    for side in sides:
        cells = cells.select("*", side)
    held = [F.col(a) - F.col(b) * tile + reach for a, b in zip("ijk", BOX[1:], strict=True)]
    cells = cells.where("bi >= 0 AND bj >= 0 AND bk >= 0").select(*BOX, ((held[0] * wide + held[1]) * wide + held[2]).cast("int").alias("_lin"), "v", F.lit(False).alias("_point"))
    shape = grids.select("scene_id", *(F.col(f"n{a}").alias(f"_n{a}") for a in "ijk"))
    own = [F.floor(F.greatest(F.least(F.col(a), F.col(f"_n{a}") - 1), F.lit(0)) / tile).cast("int").alias(b) for a, b in zip("ijk", BOX[1:], strict=True)]
    asked = points.join(shape, "scene_id").select("*", *own, F.lit(True).alias("_point"))
    both = asked.unionByName(cells, allowMissingColumns=True).withColumn("_run", F.xxhash64(*BOX))
    ordered = both.repartition(*BOX).sortWithinPartitions("_run", *BOX, "_point")
    kept = points.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vals = None, None
        for batch in batches:
            run, is_point = batch["_run"].to_numpy(), batch["_point"].to_numpy(zero_copy_only=False)
            starts = runs(run, is_point).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if run[a] != now:
                    now, vals = run[a], np.full(wide**3, np.nan)
                part = batch.slice(a, b - a)
                if not is_point[a]:
                    vals[part["_lin"].to_numpy()] = part["v"].to_numpy()
                    continue
                at = np.stack([part[c].to_numpy() for c in "ijk"], 1)[:, None, :] + shift
                ends = np.stack([part[f"_n{c}"].to_numpy() for c in "ijk"], 1)[:, None, :] - 1
                box = np.stack([part[c].to_numpy() for c in BOX[1:]], 1)[:, None, :]
                x, y, z = np.moveaxis(np.clip(at, 0, ends) - box * tile + reach, -1, 0)
                found = vals[(x * wide + y) * wide + z].ravel()
                near = pa.ListArray.from_arrays(np.arange(0, len(found) + 1, len(offsets), dtype=np.int32), pa.array(found, mask=np.isnan(found)))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), near], [*kept, "near"])

    return ordered.mapInArrow(task, points.select("*", F.lit(None).cast("array<double>").alias("near")).schema)
