"""Sources. Every reader is a Spark scan with a given schema: nothing is listed or parsed on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CLIP_SUFFIXES
from ..functions import label_of, numeric
from ..operators.presets import apply_preset
from ..schemas import BULK_FRAMES, CATALOG, EPISODE_STORE, GEO_TRACE, SEG_TRACE, VLM_TRACE, parsed
from .shared import gathered

__all__ = ["TRACES", "read_bulk_frames", "read_catalog", "read_clips", "read_episode_store", "read_mask_files", "read_model_traces", "read_preset", "read_traces", "stem"]

#: The kinds of traces and their schemas.
TRACES = {"seg": SEG_TRACE, "vlm": VLM_TRACE, "geo": GEO_TRACE}


def stem(path: str | Column = "path") -> Column:
    """A file's name without folders and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def file_path() -> Column:
    """The path of a row's file as it is called: Spark gives it with blanks and others percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _present(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_traces(spark: SparkSession, path: str, kind: str, *, strict: bool = False) -> DataFrame:
    """One row per JSON file of a folder, episode being the file's stem, label filled in from the task name.

    A file that is no JSON document is left out, or fails the job if strict. A folder that isn't there has no rows.
    """
    schema = parsed(TRACES[kind])
    if not _present(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        raw = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").schema(schema).json(path)
        out = gathered(raw.withColumn("episode", stem(file_path())))
    else:
        # Parsed from its text, a file is known to be bad whatever columns are asked for. The text comes whole, of many lines too.
        bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        raw = gathered(raw.select(F.col("content").cast("string").alias("value"), stem(file_path()).alias("_stem")))
        text = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))  # without a byte order mark
        parsed_ = raw.select(F.from_json(text, bad, {"mode": "PERMISSIVE"}).alias("r"), "_stem")
        out = parsed_.filter("r is not null and r._corrupt_record is null").select("r.*", "_stem").withColumn("episode", F.col("_stem")).drop("_corrupt_record", "_stem")
    return out.withColumn("label", label_of("label", "task_name")) if {"label", "task_name"} <= set(schema.names) else out


def read_model_traces(spark: SparkSession, root: str, *, strict: bool = True) -> DataFrame:
    """The traces of every model folder under a root, with the folder's name as model_dir. Folders without files give none.

    The folders are listed, and not a glob over their files: Spark would take each file as a path of its own.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    own = at.getFileSystem(spark._jsc.hadoopConfiguration())
    models = [f.getPath().toString() for f in own.listStatus(at) if f.isDirectory()] if own.exists(at) else []
    if not models:
        return spark.createDataFrame([], T.StructType([*parsed(VLM_TRACE).fields, T.StructField("model_dir", T.StringType())]))
    options = {"multiLine": True, "pathGlobFilter": "*.json", "recursiveFileLookup": True, "mode": "FAILFAST" if strict else "DROPMALFORMED"}
    rows = spark.read.options(**options).schema(VLM_TRACE).json(models)
    folder = F.regexp_extract(file_path(), r"^(?:[A-Za-z0-9]+:(?://[^/]*)?)?(/.*)/[^/]+$", 1)
    rows = rows.filter(folder.isin([spark._jvm.org.apache.hadoop.fs.Path(m).toUri().getPath() for m in models]))  # files further down are no traces of a model
    return gathered(rows.withColumns({"episode": stem(file_path()), "model_dir": F.regexp_extract(file_path(), r"([^/]+)/[^/]+$", 1), "label": label_of("label", "task_name")}))


def read_episode_store(spark: SparkSession, root: str) -> DataFrame:
    """(episode, attributes...) of every folder that holds an attribute document: only those documents are read.

    Where the root's own children hold none, the first subfolder in order whose children do is the root.
    """
    from .stores import register_stores

    register_stores(spark)
    rows = spark.read.format("episode_store").option("values", "documents").load(root)
    rows = rows.select("episode", F.from_json("document", EPISODE_STORE).alias("d")).select("episode", "d.attributes.*")
    return rows.withColumn("fps", numeric("fps", 30.0))


def read_bulk_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BULK_FRAMES).parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(path)


def read_preset(spark: SparkSession, path: str, presets: Mapping[str, Sequence[Column]], name: str) -> DataFrame:
    """The catalog's episodes that a named preset picks, with where they are: its filters reach the scan. An unknown name is
    an error that lists the presets."""
    return apply_preset(read_catalog(spark, path), presets, name)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(clip, path, length, content) of the video files of a folder; content is read only if it is selected."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(CLIP_SUFFIXES) + "}").load(path)
    return gathered(rows.select(stem("path").alias("clip"), "path", "length", "content"))


def read_mask_files(spark: SparkSession, path: str, index: DataFrame, *, span: int = 256 << 20, batch_bytes: int = 64 << 20) -> DataFrame:
    """The index (file, mask_offset, mask_nbytes, ...) with each mask's bytes, read from <file>.bin in the folder.

    Index rows are dealt by file and span of offsets and sorted by offset; a task opens a file once for a span and reads the
    masks' ranges alone, so files may be of any size and none of their bytes are shuffled. Without offset or size a mask is
    null; a file that isn't there, or ends before a mask does, fails the job.
    """
    from .stores import file_system

    at_file, at_offset, at_size = (index.columns.index(c) for c in ("file", "mask_offset", "mask_nbytes"))
    rows = index.repartition("file", F.floor(F.col("mask_offset") / span)).sortWithinPartitions("file", "mask_offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = file_system(path)
        name, source = None, None

        def mask(file, offset, size) -> bytes | None:
            nonlocal name, source
            if file is None or offset is None or size is None:
                return None
            if file != name:
                if source:
                    source.close()
                name, source = file, at.open_input_file(f"{root}/{file}.bin")
            data = source.read_at(size, offset)
            if len(data) < size:
                raise EOFError(f"{file}.bin ends before {offset + size}")
            return data

        for batch in batches:
            wanted = list(zip(*(batch.column(k).to_pylist() for k in (at_file, at_offset, at_size)), strict=True))
            began, held, got = 0, 0, []
            for k, row in enumerate(wanted):
                got.append(mask(*row))
                held += len(got[-1] or b"")
                if held >= batch_bytes or k + 1 == len(wanted):
                    part = batch.slice(began, k + 1 - began)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, "mask"])
                    began, held, got = k + 1, 0, []
        if source:
            source.close()

    return rows.mapInArrow(read, T.StructType([*index.schema.fields, T.StructField("mask", T.BinaryType())]))
