"""Tables in the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="framewake-")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset: under one temporary folder if all runs in this process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or _local_base()
    return f"{base.rstrip('/')}/framewake-{what}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop's objects."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table of its own, gone when the application ends at the latest."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    folder, system = _folder(df.sparkSession, path)
    system.deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*frames: DataFrame) -> None:
    """Delete the tables of written() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path, system = _folder(spark, folder)
            system.delete(path, True)
            system.cancelDeleteOnExit(path)
