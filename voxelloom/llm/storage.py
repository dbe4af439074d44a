"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a temporary folder of a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """`df` written to the shared folder as Parquet and read back: no lineage, and nothing is computed twice."""
    path = folder or new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Written tables of a job's steps by name, so that each goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Without names all that is left."""
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")
        if not names:
            remove(self.spark, self.folder)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it keeps until their plans are collected as garbage.

    For use after `written`, where nothing reads them again; a step that ends in a table can't need them for recovery.
    """
    gc.collect()
    spark._jvm.System.gc()
