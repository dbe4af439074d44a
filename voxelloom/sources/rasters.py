"""Depth and mask rasters: binary PGM (16 bits, big-endian) and PBM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.tiles import SOME_ROWS, runs, whole_runs
from voxelloom.sources.files import read_folders

_HEADER = re.compile(rb"^(P[45])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)(?:\s+(\d+))?\s")


def decode_raster(data: bytes) -> np.ndarray:
    """P5 to integers, P4 to 0 and 1, as rows x columns."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("neither a P4 nor a P5 raster")
    kind, w, h = head[1], int(head[2]), int(head[3])
    if kind == b"P4":
        head = re.match(rb"^P4\s+(?:#[^\n]*\n\s*)*\d+\s+\d+\s", data)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=head.end()).reshape(h, -1), axis=1)
        return bits[:, :w].astype(np.int64)
    deep = int(head[4]) > 255
    return np.frombuffer(data, ">u2" if deep else np.uint8, count=w * h, offset=head.end()).reshape(h, w).astype(np.int64)


def encode_pgm(values: np.ndarray) -> bytes:
    return f"P5\n{values.shape[1]} {values.shape[0]}\n65535\n".encode() + values.astype(">u2").tobytes()


def encode_pbm(mask: np.ndarray) -> bytes:
    return f"P4\n{mask.shape[1]} {mask.shape[0]}\n".encode() + np.packbits(mask.astype(np.uint8), axis=1).tobytes()


def explode_rasters(files: DataFrame, value: str) -> DataFrame:
    """(file, row, col, <value>) of rows (file, content); 0 stays 0, see the depth decoders. Small files share a batch."""

    def pixels(names: list[str], images: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [v.size for v in images]
        at = [np.indices(v.shape, np.int32).reshape(2, -1) for v in images]
        row, col = np.concatenate(at, 1)
        file = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
        return pa.RecordBatch.from_arrays([file, pa.array(row), pa.array(col), pa.array(np.concatenate([v.ravel() for v in images]))], ["file", "row", "col", value])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, images, n = [], [], 0
            for file, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                names.append(file)
                images.append(decode_raster(content.as_py()))
                n += images[-1].size
                if n >= SOME_ROWS:
                    yield pixels(names, images)
                    names, images, n = [], [], 0
            if names:
                yield pixels(names, images)

    return files.select("file", "content").mapInArrow(task, f"file string, row int, col int, {value} long")


def read_rasters(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Pixels of all rasters under a path; `file` is the last two parts of the file's path. Of `<folder>/*/*` tasks list the files."""
    if path.endswith("/*/*") and "*" not in path[:-4]:
        return explode_rasters(read_folders(spark, path[:-4]), value)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("file"), "content")
    return explode_rasters(files, value)


def encode_rasters(pixels: DataFrame, key: list[str], value: str, h: int, w: int, mask: bool = False) -> DataFrame:
    """(file, content) of each image, absent pixels 0; images are made some at a time."""
    file = F.concat_ws("/", *(F.col(c).cast("string") for c in key)).alias("file")
    kept = pixels.select(file, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("long").alias("v"))
    ordered = kept.withColumn("run", F.xxhash64("file")).repartition("file").sortWithinPartitions("run", "file")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, (1 << 20) // (h * w))
        for batch in whole_runs(batches):
            starts = runs(batch["run"].to_numpy())
            row, col, v = (batch[c].to_numpy() for c in ("row", "col", "v"))
            for first in range(0, len(starts), some):
                own = starts[first : first + some]
                a, b = own[0], starts[first + some] if first + some < len(starts) else batch.num_rows
                images = np.zeros((len(own), h, w), np.int64)
                images[np.searchsorted(own, np.arange(a, b), "right") - 1, row[a:b], col[a:b]] = v[a:b]
                content = [encode_pbm(x) if mask else encode_pgm(x) for x in images]
                yield pa.RecordBatch.from_arrays([batch["file"].take(pa.array(own)), pa.array(content, pa.binary())], ["file", "content"])

    return ordered.mapInArrow(task, "file string, content binary")
