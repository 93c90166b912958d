"""Folders that driver and executors share, for files that one job writes and another reads, and scans of many files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name under spark.checkpoint.dir; what is in it goes when the session's JVM ends.

    Where the session names none, local mode (tests) takes a temporary folder of this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelmark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in a shared folder: computed once, however often they are read, and lineage ends there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(files: DataFrame, *, parts: int = 16) -> DataFrame:
    """A scan of small files in fewer tasks: up to `parts` of its partitions in one, as long as two tasks a core are left.

    Spark counts 4 MB for opening a file, so 32 files of any size are a task, whose start costs more than they do.
    """
    return files.coalesce(max(2 * files.sparkSession.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // parts))
