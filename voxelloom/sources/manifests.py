"""Scene manifests, frame lists and poses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.grid import spread
from voxelloom.operators.tiles import runs, whole_runs
from voxelloom.sources.files import read_folders

#: The same documents as PyYAML's own classes, read and written by libyaml where it is there.
LOADER, DUMPER = (getattr(yaml, f"C{c}", getattr(yaml, c)) for c in ("SafeLoader", "SafeDumper"))
SEQUENCES = "split string, name string, folder string, scene string, frames array<int>"
FRAMES = "folder string, frame_id string, image string, rgb string, mask string, k array<double>, h_mat array<double>, depth_scaling double"


def moved_folder(folder: Column, root: Column) -> Column:
    """The last directory of a path (which ends in a slash) under another root."""
    return F.concat(root, F.lit("/"), F.element_at(F.split(folder, "/"), -2), F.lit("/"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(folder, value) of text files; those of one name in the folders of `<root>/*/<name>` are opened in tasks."""
    root, _, name = path.rpartition("/*/")
    if root and "*" not in root and not any(c in name for c in "*?[{/"):
        return read_folders(spark, root, name).select(F.regexp_extract("file", r"([^/]*)/[^/]*$", 1).alias("folder"), F.decode("content", "utf-8").alias("value"))
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1).alias("folder"), "value")


def read_sequences(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A split's YAML list of sequences."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(split, str(x["name"]), x["folder"], str(x["scene"]), [int(f) for f in x["frames"]]) for text in pdf["value"] for x in yaml.load(text, LOADER) or []]
            yield pd.DataFrame(rows, columns=["split", "name", "folder", "scene", "frames"])

    return _documents(spark, path).select("value").mapInPandas(task, SEQUENCES)


def read_poses(spark: SparkSession, path: str, frame_ids: list[str] | None = None) -> DataFrame:
    """Frames of the pose files under a path, one YAML list a scene folder; `frame_ids` picks some."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda m: [float(v) for row in m for v in (row if isinstance(row, list) else [row])]
        for pdf in it:
            rows = [(folder, str(x["id"]), x["image"], x.get("rgb"), x.get("mask"), flat(x["intrinsics"]), flat(x["pose"]), float(x.get("depth_scaling", 1))) for folder, text in zip(pdf["folder"], pdf["value"], strict=True) for x in yaml.load(text, LOADER) or []]
            yield pd.DataFrame(rows, columns=["folder", "frame_id", "image", "rgb", "mask", "k", "h_mat", "depth_scaling"])

    frames = _documents(spark, path).mapInPandas(task, FRAMES)
    return frames.where(F.col("frame_id").isin(frame_ids)) if frame_ids is not None else frames


def expand_frame_lists(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of one frame from text files with a frame number a line, one file a scene folder."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1).alias("scene"), F.trim("value").alias("frame")).where("frame <> ''")
    return lines.select(F.concat("scene", F.lit("_["), "frame", F.lit("]")).alias("name"), "scene", F.array(F.col("frame").cast("int")).alias("frames"))


def pose_files(frames: DataFrame, image: str) -> DataFrame:
    """(file, content) of a pose file for each scene, its frames in order; a frame's image is named by its number."""

    def text(frames: list[dict]) -> bytes:
        grid = lambda x, n: [[float(v) for v in x[k : k + n]] for k in range(0, n * n, n)]
        rows = [{"id": int(r["frame_id"]), "image": f"{image}{r['frame_id']}.pgm", "intrinsics": grid(r["k"], 3), "pose": [float(v) for v in r["h_mat"]], "depth_scaling": float(r["depth_scaling"])} for r in frames]
        return yaml.dump(rows, Dumper=DUMPER).encode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 1 << 12):
            starts, frames = runs(batch["run"].to_numpy()).tolist(), batch.to_pylist()
            files = [(f"{frames[a]['scene_id']}/poses.yaml", text(frames[a:b])) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([c for _, c in files], pa.binary())], ["file", "content"])

    own = frames.select("scene_id", "frame_id", "k", "h_mat", "depth_scaling").withColumn("run", F.xxhash64("scene_id"))
    ordered = spread(own, "scene_id").sortWithinPartitions("run", "scene_id", "frame_id")
    return ordered.mapInArrow(task, "file string, content binary")
