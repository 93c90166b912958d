"""Traces as they arrive: scoring every new trace file once.

The audits are batch jobs; this only spares reading finished traces again. A query's checkpoint takes the place of
listing what is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import label_of, tag_above
from ..operators.confidence import add_curve_statistics
from ..schemas import VLM_TRACE
from ..sources.traces import stem


def stream_traces(spark: SparkSession, path: str, *, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of confidence traces, a row per JSON file that appears in a folder."""
    rows = spark.readStream.schema(VLM_TRACE).option("multiLine", True).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumns({"episode": stem("_metadata.file_path"), "label": label_of("label", "task_name")})


def stream_tags(traces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The statistics and the tag of each trace of a stream: stateless."""
    return add_curve_statistics(traces).select("episode", "label", "p_done_late", "p_done_final", "p_done_max", "p_done_rise", tag_above("p_done_late", F.lit(threshold)).alias("tag"))
