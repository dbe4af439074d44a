"""Files written from tables of (file, content), one file a row, on a store that all executors reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders over which the scenes of a table are dealt.
PARTS = 256


#: Bytes of small files that a task reads before it hands them on.
READ_BYTES = 1 << 20


def store_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of a path, with the path as the store has it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def dealt(rows: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows with the folder `part` of their scene, a folder in one task and its scenes in order: as many files as folders, not
    as scenes or tasks. A reader of one scene filters by the same hash and its name."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    return rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", key)


def write_files(files: DataFrame, folder: str) -> int:
    """Each row's `content` (binary) as `folder`/`file`; returns how many there are.

    A file is written beside its place and moved there, so a task that runs twice leaves whole files only.
    """

    def task(batches):
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                store, path = arrow_fs.FileSystem.from_uri(f"{folder}/{name}") if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), f"{folder}/{name}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, path)
            yield pdf[["file"]]

    return files.select("file", "content").mapInPandas(task, "file string").count()


def read_folders(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(file, content) of the files in the folders of `folder`, or of those of one `name`; `file` is the last two parts of the path.

    The driver lists the folders only; tasks list and read what is in them, so that files need not be known to the driver.
    """
    store, root = store_of(folder.rstrip("/"))
    names = sorted(f.base_name for f in store.get_file_info(arrow_fs.FileSelector(root)) if f.type == arrow_fs.FileType.Directory)
    rows = spark.createDataFrame(pa.table({"folder": pa.array(names, pa.string())}), "folder string")
    schema = pa.schema([("file", pa.string()), ("content", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder.rstrip("/"))
        for batch in batches:
            held, size = [], 0
            for own in batch["folder"].to_pylist():
                infos = store.get_file_info(arrow_fs.FileSelector(f"{root}/{own}") if name is None else [f"{root}/{own}/{name}"])
                for info in infos:
                    if info.type != arrow_fs.FileType.File or info.base_name.endswith(".tmp"):
                        continue
                    with store.open_input_stream(info.path) as f:
                        held.append({"file": f"{own}/{info.base_name}", "content": f.read()})
                    size += len(held[-1]["content"])
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder").mapInArrow(task, "file string, content binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that a pattern names."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content")
