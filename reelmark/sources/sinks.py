"""Sinks: traces as JSON or Parquet by episode, mask files with their offsets, small tables as Markdown."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import running_offset
from .shared import gathered


def without_blobs(df: DataFrame) -> DataFrame:
    """The table without its binary columns, which do not belong in a trace."""
    return df.drop(*[f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)])


def write_traces(df: DataFrame, path: str, *, kind: str = "json", key: str = "episode") -> None:
    """One folder per episode; binary columns are left out. Spark's committer marks a complete write."""
    without_blobs(df).write.partitionBy(key).format(kind).mode("overwrite").save(path)


def write_episodes(df: DataFrame, path: str, *, key: str = "episode", kind: str = "parquet") -> None:
    """The rows in `path`/data, and then, in `path`/complete, (key, complete) of every episode written. Markers follow the
    data, so an episode without one was not written whole; loading.skip_completed() takes them as they are."""
    df.write.mode("overwrite").format(kind).save(f"{path}/data")
    done = df.sparkSession.read.format(kind).schema(df.schema).load(f"{path}/data")
    done.select(key).distinct().withColumn("complete", F.lit(True)).write.mode("overwrite").parquet(f"{path}/complete")


def plain(value: Column, kind: T.DataType) -> Column:
    """A value as documents hold it: NaN and infinities are null, fields of structs and keys of maps sorted by name, bytes as
    base64; within arrays, maps and structs too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], plain(e["value"], kind.valueType))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[plain(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return value


def documents(df: DataFrame, *, key: str = "episode") -> DataFrame:
    """(key, document): each row as a JSON text with its nesting, its fields sorted by name, nulls written out. Rows alike
    have texts alike; from_json with the rows' schema is the way back, but that NaN is null and bytes are base64."""
    fields = [plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.col(key), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def write_files(files: DataFrame, folder: str, *, name: str = "name", data: str = "data") -> int:
    """Writes each row's text or bytes as a file of the folder and returns how many. Names may hold sub-folders.

    A file is written in a hidden folder of the attempt's own and then moved, so repeated attempts leave whole files; files of
    other names stay. Null data is an empty file. Rows are written by the tasks that hold them; the folder they share, where they
    would wait for one another, sees the move alone.
    """
    from .stores import file_system

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = file_system(folder)
        own = f"{root}/.{uuid.uuid4().hex}"
        at.create_dir(own, recursive=True)
        try:
            for batch in batches:
                for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if "/" in file:
                        at.create_dir(f"{root}/{file}".rpartition("/")[0], recursive=True)
                    with at.open_output_stream(f"{own}/file", compression=None) as f:
                        if content.is_valid:
                            f.write(content.as_buffer())
                    at.move(f"{own}/file", f"{root}/{file}")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        finally:
            at.delete_dir(own)

    return files.select(F.col(name).cast("string"), F.col(data)).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_documents(df: DataFrame, folder: str, *, key: str = "episode") -> int:
    """Each row as <key>.json, as documents() makes them: what read_traces() reads. Returns how many."""
    return write_files(documents(without_blobs(df), key=key).select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), F.col("document").alias("data")), folder)


def collect_artifacts(verdicts: DataFrame, folder: str, *, key: str = "episode") -> DataFrame:
    """Every verdict with the files of its episode's sub-folder: (verdict columns, artifacts), an array of (path, length) by
    path; empty without files. Files are listed, not read; those without a byte are left out. The folder must be there."""
    files = verdicts.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = re.sub("^[a-z0-9]+:(//[^/]*)?", "", folder).rstrip("/")
    own = gathered(files.select("path", "length")).select("path", "length", F.regexp_extract("path", rf"\Q{base}\E/([^/]+)/.+", 1).alias("_episode")).filter("_episode <> ''")
    own = own.groupBy("_episode").agg(F.array_sort(F.collect_list(F.struct("path", "length"))).alias("artifacts"))
    out = verdicts.join(own, F.col(key).cast("string") == F.col("_episode"), "left").drop("_episode")
    return out.withColumn("artifacts", F.coalesce("artifacts", F.array().cast(own.schema["artifacts"].dataType)))


def mask_text(mask: str = "mask") -> Column:
    """A packed mask as base64 text, for traces that hold no bytes; unbase64 is the way back."""
    return F.base64(mask)


def mask_files(masks: DataFrame, folder: str, *, key: str = "episode", order: Sequence[str] = ("frame_idx", "object_id"), mask: str = "mask") -> DataFrame:
    """Writes each episode's masks one after another into <episode>.bin, once, and returns the index (key, order, mask_offset,
    mask_nbytes) as it is written beside them, in <folder>/index.

    Tasks stream their rows; a file is open only while its episode's rows come by. It is written under a name of the attempt's
    own and gets its name when it is whole, so attempts of one task, repeated or at a time, leave one and the same file.
    A null mask has no bytes. Rows come to the writers as the offsets' window deals them, by episode: one shuffle.
    """
    from .stores import file_system

    size = F.coalesce(F.length(mask), F.lit(0)).cast("bigint")
    index = running_offset(masks.withColumn("mask_nbytes", size), [key], F.struct(*order), "mask_nbytes", "mask_offset")
    rows = index.select(F.col(key).cast("string").alias(key), *order, "mask_offset", "mask_nbytes", mask)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = file_system(folder)
        at.create_dir(root, recursive=True)
        sink, now, attempt = None, None, ""

        def close() -> None:
            nonlocal sink
            if sink:
                sink.close()
                at.move(attempt, f"{root}/{now}.bin")
                sink = None

        try:
            for batch in batches:
                data = batch.column(batch.num_columns - 1)
                for k, episode in enumerate(batch.column(0).to_pylist()):
                    if sink is None or episode != now:
                        close()
                        now, attempt = episode, f"{root}/.{episode}.{uuid.uuid4().hex}"
                        sink = at.open_output_stream(attempt, compression=None)
                    if data[k].is_valid:
                        sink.write(data[k].as_buffer())
                yield batch.select(batch.schema.names[:-1])
            close()
        finally:
            if sink:  # the task has failed
                sink.close()
                at.delete_file(attempt)

    schema = T.StructType([f for f in rows.schema.fields if f.name != mask])
    rows.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{folder}/index")
    return masks.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def markdown(df: DataFrame, headers: Sequence[str] | None = None) -> Iterator[str]:
    """The lines of a Markdown table, fetched a partition at a time; for report tables. Null is a dash, floats have two decimals."""
    yield "| " + " | ".join(headers or df.columns) + " |"
    yield "|" + "---|" * len(df.columns)
    for row in df.toLocalIterator():
        yield "| " + " | ".join("—" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x) for x in row) + " |"


def contact_sheet(df: DataFrame, order: Sequence[str], *, keys: Sequence[str], columns: int, width: int, height: int, pad: int) -> DataFrame:
    """Adds each picture's cell of a grid: grid_row, grid_col, x, y."""
    from ..operators.sequence import ordered

    n = F.row_number().over(ordered(keys, F.struct(*order))) - 1
    out = df.withColumn("_n", n)
    row, col = F.floor(F.col("_n") / columns).cast("int"), (F.col("_n") % columns).cast("int")
    return out.withColumns({"grid_row": row, "grid_col": col, "x": col * (width + pad) + pad, "y": row * (height + pad) + pad}).drop("_n")
