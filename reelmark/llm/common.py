"""What the operators of this package share: the shared folder, written tables, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folders that kept_alone() is told of: its own list, in each thread or task that runs one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, removed when the session's JVM ends.

    Where the session names none, a temporary folder of this machine is set as the checkpoint folder in local mode
    (tests); on a cluster, whose executors would each write to their own disk, that is an error.
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
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that `written` made, once nothing reads it any more."""
    _delete(df.sparkSession, df.scratch)


def kept_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s rows, written; what was written on the way to them is deleted then, also if it fails."""
    made: list[str] = []
    outer = _MADE.set(made)
    out = None
    try:
        out = written(make(), label)
    finally:
        _MADE.reset(outer)
        for path in made:
            if out is None or path != out.scratch:
                _delete(spark, path)
    above = _MADE.get()
    if above is not None:
        above.append(out.scratch)
    return out


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, in any case."""
    gone = {n.lower() for n in names}
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in gone]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select([f"c{k}" for k in kept]).toDF(*(df.columns[k] for k in kept))


def map_columns(df: DataFrame, run: Callable, added: str, *, keep: Callable[[str], bool] = lambda c: True) -> DataFrame:
    """df.mapInArrow(run) where run returns df's columns, but those that keep leaves out, and the added ones (a schema).

    In the tasks columns are named c0, c1, ...: a batch is taken by place, so that names may be anything.
    """
    kept = [k for k, c in enumerate(df.columns) if keep(c)]
    schema = [f"c{k} {df.schema[k].dataType.simpleString()}" for k in kept]
    out = df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, ", ".join([*schema, added]))
    return out.toDF(*(df.columns[k] for k in kept), *out.columns[len(kept) :])


def parts(spark: SparkSession) -> int:
    """Partitions to deal rows over by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod folds is fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
