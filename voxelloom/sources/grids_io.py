"""Voxel grids in files: half-precision dumps in C order beside a YAML description.

A dump is read and written by slabs, so that no task holds a grid: see `GridDumps` and `write_dumps`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelloom.operators.grid import spread
from voxelloom.operators.tiles import runs
from voxelloom.sources.files import dealt, store_of
from voxelloom.sources.manifests import DUMPER, LOADER

GRIDS = "scene_id string, kind string, ni int, nj int, nk int, vox_size double, origin array<double>, rot array<double>"


def _scene(path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(path), r"([^/]*)/[^/]*$", 1)


def read_grid_meta(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One YAML file (R, T, voxelsize, shape) in each scene's folder."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for scene, text in zip(pdf["scene_id"], pdf["value"], strict=True):
                m = parsed_meta(text)
                rows.append((scene, kind, *m["shape"], m["vox_size"], m["origin"], m["rot"]))
            yield pd.DataFrame(rows, columns=["scene_id", "kind", "ni", "nj", "nk", "vox_size", "origin", "rot"])

    return spark.read.text(path, wholetext=True).select(_scene().alias("scene_id"), "value").mapInPandas(task, GRIDS)


#: Cells of a dump that one task reads or writes at once.
SLAB_CELLS = 1 << 22
_CELL_BYTES = 2


def parsed_meta(text: str) -> dict:
    m = yaml.load(text, LOADER)
    flat = lambda x: [float(v) for v in np.asarray(x, float).ravel()]
    return {"shape": [int(n) for n in m["shape"]], "vox_size": float(m["voxelsize"]), "origin": flat(m["T"]), "rot": flat(m["R"])}


#: Cells that the reader hands on together.
_SOME_CELLS = 1 << 16


class Slab(InputPartition):
    """Byte ranges of some dumps, (scene, bytes of the file, first cell, cells) each, that are read in one task."""

    def __init__(self, ranges: list[tuple]):
        super().__init__(0)
        self.ranges = ranges


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.slab = int(options.get("slab_cells", SLAB_CELLS))
        self.data, self.meta = options.get("data", "grid.dat"), options.get("meta", "grid.yaml")

    def partitions(self) -> list[Slab]:
        """Large dumps are cut into ranges of `slab_cells`, small ones share a task up to that many cells, by the sizes of their
        files, which one listing tells; descriptions are read in tasks."""
        store, root = store_of(self.options["path"].rstrip("/"))
        sizes, described = {}, set()
        for info in store.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
            *folder, scene, name = info.path.rsplit("/", 2)
            if info.type == arrow_fs.FileType.File and folder == [root]:
                if name == self.data:
                    sizes[scene] = info.size
                if name == self.meta:
                    described.add(scene)
        out, held, room = [], [], self.slab
        for scene in sorted(described):
            size, at = sizes.get(scene, 0), 0
            n = size // _CELL_BYTES
            while at < n or not at:  # an empty file too is held against its description
                some = min(room, n - at)
                held.append((scene, size, at, some))
                at, room = at + max(1, some), room - some
                if not room:
                    out.append(Slab(held))
                    held, room = [], self.slab
        return [*out, Slab(held)] if held or not out else out

    def _ranges(self, partition: Slab) -> Iterator[tuple[str, tuple[int, ...], int, np.ndarray]]:
        """Scene, shape, first cell and values of some cells at a time."""
        store, root = store_of(self.options["path"].rstrip("/"))
        for scene, size, first, n in partition.ranges:
            with store.open_input_stream(f"{root}/{scene}/{self.meta}") as f:
                shape = parsed_meta(f.read().decode())["shape"]
            total, path = int(np.prod(shape)), f"{root}/{scene}/{self.data}"
            if size < total * _CELL_BYTES:
                raise ValueError(f"{path} ends before its description says")
            end = min(first + n, total)
            if first >= end:
                continue
            with store.open_input_file(path) as f:
                for at in range(first, end, _SOME_CELLS):
                    some = min(_SOME_CELLS, end - at)
                    v = np.frombuffer(f.read_at(some * _CELL_BYTES, at * _CELL_BYTES), "<f2").astype(float)
                    if len(v) < some:
                        raise ValueError(f"{path} ends before its description says")
                    yield scene, shape, at, v

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        kind, every = self.options.get("kind", "grid"), self.options.get("unknown", "true") == "true"
        names, parts, n = [], [], 0

        def made() -> pa.RecordBatch:
            i, j, k, v = (np.concatenate(c) for c in zip(*parts, strict=True))
            scene = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])))
            return pa.RecordBatch.from_arrays([scene, pa.repeat(kind, len(v)), *(pa.array(x.astype(np.int32)) for x in (i, j, k)), pa.array(v, mask=np.isnan(v))], ["scene_id", "kind", "i", "j", "k", "v"])

        for scene, (_, nj, nk), at, v in self._ranges(partition):
            lin = np.arange(at, at + len(v)) if every else at + np.flatnonzero(~np.isnan(v))
            v = v if every else v[lin - at]
            names.append(scene)
            parts.append((lin // (nj * nk), lin // nk % nj, lin % nk, v))
            n += len(v)
            if n >= _SOME_CELLS:
                yield made()
                names, parts, n = [], [], 0
        if parts:
            yield made()


class GridDumps(DataSource):
    """`spark.read.format("grid_dump").load(folder)`: the dumps in the scenes' folders under `folder`, as cells.

    Options: `data` and `meta`, the names of the two files (grid.dat, grid.yaml); `kind`; `slab_cells`, the most cells a task;
    `unknown`, false to leave NaN cells out. The driver lists names and sizes only; a task reads the descriptions and its ranges of
    bytes, some at a time, so a dump may be larger than any task. Folders are on a store that pyarrow reaches.
    """

    @classmethod
    def name(cls) -> str:
        return "grid_dump"

    def schema(self) -> str:
        return "scene_id string, kind string, i int, j int, k int, v double"

    def reader(self, schema) -> DumpReader:
        return DumpReader(dict(self.options))


def read_dumps(spark: SparkSession, folder: str, kind: str = "grid", **options) -> DataFrame:
    """Cells (scene_id, kind, i, j, k, v) of the dumps under a folder, as `GridDumps` reads them; NaN is NULL."""
    spark.dataSource.register(GridDumps)
    return spark.read.format("grid_dump").options(kind=kind, **options).load(folder)


def write_dumps(voxels: DataFrame, meta: DataFrame, folder: str, slab_cells: int = SLAB_CELLS) -> int:
    """A dump and its description in a folder for each scene of `meta`, whatever its size; returns how many there are.

    Cells are dealt to slabs of the dump, consecutive places in C order, each of which one task fills (NaN where no cell is) and
    writes: a dump of one slab at once with its description, others as a file a slab, which a task a scene then puts behind each
    other, copying some bytes at a time. Files are written beside their place and moved there, so a task that runs twice leaves
    whole files only. Cells outside the shape are left out; of cells that repeat one stays.
    """
    scenes = meta.select(F.col("scene_id").cast("string").alias("scene_id"), "ni", "nj", "nk", "vox_size", "origin", "rot")
    shape = scenes.select("scene_id", "ni", "nj", "nk")
    total = F.col("ni").cast("long") * F.col("nj") * F.col("nk")
    slabs = scenes.select("*", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((total - 1) / slab_cells), F.lit(0)))).alias("slab"))
    inside = [F.col(c).between(0, F.col(f"n{c}") - 1) for c in "ijk"]
    cells = voxels.where("v IS NOT NULL").select(F.col("scene_id").cast("string").alias("scene_id"), "i", "j", "k", "v").join(shape, "scene_id").where(inside[0] & inside[1] & inside[2])
    lin = (F.col("i").cast("long") * F.col("nj") + F.col("j")) * F.col("nk") + F.col("k")
    placed = cells.select("scene_id", F.floor(lin / slab_cells).alias("slab"), F.pmod(lin, F.lit(slab_cells)).alias("at"), F.col("v").cast("double").alias("v"), F.lit(True).alias("is_cell"))
    rows = slabs.withColumn("is_cell", F.lit(False)).unionByName(placed, allowMissingColumns=True)
    ordered = rows.withColumn("run", F.xxhash64("scene_id", "slab")).repartition("scene_id", "slab").sortWithinPartitions("run", "scene_id", "slab", "is_cell")

    def put(path: str, pieces: Iterator[bytes]) -> None:
        store, own = store_of(path)
        store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        beside = f"{own}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(beside) as out:
            for piece in pieces:
                out.write(piece)
        store.move(beside, own)

    def describe(m: dict) -> None:
        text = yaml.dump({"R": np.array(m["rot"]).reshape(3, 3).tolist(), "T": [float(x) for x in m["origin"]], "voxelsize": float(m["vox_size"]), "shape": [m["ni"], m["nj"], m["nk"]]}, Dumper=DUMPER)
        put(f"{folder}/{m['scene_id']}/grid.yaml", iter([text.encode()]))

    described = scenes.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slab, place, n_whole = None, None, None, 0
        for batch in batches:
            run, is_cell = batch["run"].to_numpy(), batch["is_cell"].to_numpy(zero_copy_only=False)
            starts = runs(run, is_cell).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if is_cell[a]:
                    if run[a] == now:
                        slab[batch["at"].slice(a, b - a).to_numpy()] = batch["v"].slice(a, b - a).to_numpy()
                    continue
                if place:
                    put(place, iter([slab.tobytes()]))
                m = {c: batch[c][a].as_py() for c in (*described, "slab", "total")}
                whole = m["total"] <= slab_cells
                now, place = run[a], f"{folder}/{m['scene_id']}/grid.dat" + ("" if whole else f".slabs/{m['slab']}")
                slab = np.full(min(slab_cells, m["total"] - m["slab"] * slab_cells), np.nan, "<f2")
                if whole:
                    describe(m)
                    n_whole += 1
        if place:
            put(place, iter([slab.tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array([n_whole], pa.int64())], ["n"])

    n_whole = ordered.mapInArrow(fill, "n long").agg(F.sum("n")).first()[0] or 0

    def copied(store: arrow_fs.FileSystem, paths: list[str]) -> Iterator[bytes]:
        for path in paths:
            with store.open_input_stream(path) as f:
                while piece := f.read(8 << 20):
                    yield piece

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                own = f"{folder}/{m['scene_id']}"
                store, place = store_of(own)
                n = -(-m["ni"] * m["nj"] * m["nk"] // slab_cells)
                if store.get_file_info(f"{place}/grid.dat.slabs").type == arrow_fs.FileType.Directory:  # else a first attempt has ended
                    put(f"{own}/grid.dat", copied(store, [f"{place}/grid.dat.slabs/{k}" for k in range(n)]))
                    store.delete_dir(f"{place}/grid.dat.slabs")
                describe(m)
            yield pa.RecordBatch.from_arrays([batch["scene_id"]], ["scene_id"])

    return n_whole + spread(scenes.where(total > slab_cells), "scene_id").mapInArrow(join, "scene_id string").count()


def write_grids(voxels: DataFrame, path: str) -> None:
    """The canonical form: Parquet, whole scenes dealt over folders, in order in their file."""
    dealt(voxels).write.partitionBy("part").parquet(path)


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.partitionBy("block_type").parquet(path)


def read_examples(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Training records of the scenes in a manifest; scenes without records are skipped."""
    return spark.read.parquet(path).join(manifest.select("scene_id").distinct(), "scene_id", "left_semi")
