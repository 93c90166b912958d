"""Windows over the frames of a sequence.

Every operator here partitions by the sequence's keys alone, so a plan of several of them shuffles once. Frames
are taken in the order of `order`; positions count from 0 in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def ordered(keys: Sequence[str], order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def up_to_here(keys: Sequence[str], order: str | Column) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def from_here(keys: Sequence[str], order: str | Column) -> WindowSpec:
    return ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)


def positions(df: DataFrame, keys: Sequence[str], order: str, *, pos: str = "pos", n: str = "n") -> DataFrame:
    """Adds each frame's position and the number of frames of its sequence."""
    return df.withColumns({pos: F.row_number().over(ordered(keys, order)) - 1, n: F.count("*").over(whole(keys))})


def quarters(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds pos, n, in_first and in_last: whether a frame is of the first or last quarter, at least one frame long."""
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return positions(df, keys, order).withColumns({"in_first": F.col("pos") < q, "in_last": F.col("pos") >= F.col("n") - q})


def stride_sample(df: DataFrame, index: str, stride: int) -> DataFrame:
    """Every stride-th frame by its index; strides under 1 are 1. A plain filter, pushed to the scan where it can be."""
    return df.filter(F.col(index) % max(1, stride) == 0)


def frame_cap(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """The first `most` frames of each sequence; 0 keeps all."""
    if not most:
        return df
    return df.withColumn("_rn", F.row_number().over(ordered(keys, order))).filter(F.col("_rn") <= most).drop("_rn")


def even_pick(df: DataFrame, keys: Sequence[str], order: str, wanted: int) -> DataFrame:
    """At most `wanted` frames of each sequence, evenly spaced from the first one."""
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / wanted))
    return positions(df, keys, order, pos="_pos", n="_n").filter((F.col("_pos") % step == 0) & (F.floor(F.col("_pos") / step) < wanted)).drop("_pos", "_n")


def prefer(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """The frames that meet a condition; all frames of a sequence in which none does."""
    return df.withColumn("_ok", F.coalesce(condition, F.lit(False))).withColumn("_any", F.max("_ok").over(whole(keys))).filter("_ok or not _any").drop("_ok", "_any")


def carried(value: str | Column, keys: Sequence[str], order: str | Column) -> Column:
    """The latest value that is not null, at or before a frame."""
    return F.last(value, ignorenulls=True).over(up_to_here(keys, order))


def carried_or_last(value: str | Column, keys: Sequence[str], order: str) -> Column:
    """The latest value at or before a frame; before the first one, the sequence's last."""
    every = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(carried(value, keys, order), F.last(value, ignorenulls=True).over(every))


def moved_less(value: str, keys: Sequence[str], order: str, lag: int, below: float) -> Column:
    """Whether a value differs by less than `below` from that `lag` frames before; false without one."""
    return F.coalesce(F.abs(F.col(value) - F.lag(value, lag).over(ordered(keys, order))) < below, F.lit(False))


def gradient(value: str, keys: Sequence[str], order: str) -> Column:
    """Central differences, one-sided at the ends; null for a single frame and beside missing values."""
    w = ordered(keys, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    rn, n = F.row_number().over(w), F.count("*").over(whole(keys))
    x = F.col(value)
    return F.when(n == 1, None).when(rn == 1, after - x).when(rn == n, x - before).otherwise((after - before) / 2)


def step_length(values: Sequence[str], keys: Sequence[str], order: str) -> Column:
    """Euclidean distance to the frame before; null for the first and beside missing values."""
    w = ordered(keys, order)
    return F.sqrt(sum(((F.col(v) - F.lag(v).over(w)) * (F.col(v) - F.lag(v).over(w)) for v in values), F.lit(0.0)))


def next_position(condition: Column, keys: Sequence[str], order: str, pos: str = "pos") -> Column:
    """The position of the first frame, here or later, that meets a condition. A window of any length, even one that
    differs by sequence, is then a comparison."""
    return F.first(F.when(condition, F.col(pos)), ignorenulls=True).over(from_here(keys, order))


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: str, *, aggs: Sequence[Column] = ()) -> DataFrame:
    """The runs of frames whose flag holds: keys, run_start, run_end (exclusive), run_length, and more aggregates.

    A run is a group of flagged frames of one difference between position and number among the flagged.
    """
    pos = df.withColumn("_pos", F.row_number().over(ordered(keys, order)) - 1).filter(F.coalesce(F.col(flag), F.lit(False)))
    runs = pos.withColumn("_run", F.col("_pos") - F.row_number().over(ordered(keys, order)))
    out = runs.groupBy(*keys, "_run").agg(F.min("_pos").alias("run_start"), (F.max("_pos") + 1).alias("run_end"), F.count("*").alias("run_length"), *aggs)
    return out.drop("_run")


def longest_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest run of each sequence; of equals, the first."""
    best = F.max_by(F.struct("run_start", "run_end", "run_length"), F.struct("run_length", -F.col("run_start")))
    return runs.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def merge_series(target: DataFrame, source: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Targets and sources of each sequence in one table: (keys, at, _value, _src), sources first at equal places."""
    t = target.select(*keys, F.col(at), F.lit(None).cast("double").alias("_value"), F.lit(False).alias("_src"))
    s = source.select(*keys, F.col(at), F.col(value).cast("double").alias("_value"), F.lit(True).alias("_src"))
    return t.unionByName(s)


def interpolate(target: DataFrame, source: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """(keys, at, value): the source's values at the target's places, linear between neighbours, clamped at both ends;
    null in a sequence without sources. One shuffle."""
    both = merge_series(target, source, keys, at, value)
    order = F.struct(F.col(at), ~F.col("_src"))
    point = F.when(F.col("_src"), F.struct(F.col(at).cast("double").alias("t"), F.col("_value").alias("v")))
    both = both.withColumns({"_a": F.last(point, ignorenulls=True).over(up_to_here(keys, order)), "_b": F.first(point, ignorenulls=True).over(from_here(keys, order))})
    a, b = F.col("_a"), F.col("_b")
    share = (F.col(at) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))
    return both.filter("not _src").select(*keys, at, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share).alias(value))


def held(target: DataFrame, source: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """(keys, at, value): the source's latest value at or before each target place; before the first, the first. One shuffle."""
    both = merge_series(target, source, keys, at, value)
    order = F.struct(F.col(at), ~F.col("_src"))
    point = F.when(F.col("_src"), F.struct(F.col("_value").alias("v")))
    got = F.coalesce(F.last(point, ignorenulls=True).over(up_to_here(keys, order)), F.first(point, ignorenulls=True).over(from_here(keys, order)))
    return both.withColumn("_got", got).filter("not _src").select(*keys, at, F.col("_got")["v"].alias(value))


def progress(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds progress: 0 for the first frame to 1 for the last; 0 for a single frame."""
    out = positions(df, keys, order, pos="_pos", n="_n")
    return out.withColumn("progress", F.coalesce(F.col("_pos") / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0))).drop("_pos", "_n")


def prefix_statistics(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds what is known of a value up to and with each frame: so_far, a struct of n, total, mean, least, most and first.

    One state is carried along a sequence, so memory doesn't grow with its length; nulls don't count.
    """
    w = up_to_here(keys, order)
    so_far = F.struct(F.count(value).over(w).alias("n"), F.sum(value).over(w).alias("total"), F.avg(value).over(w).alias("mean"), F.min(value).over(w).alias("least"), F.max(value).over(w).alias("most"), F.first(value, ignorenulls=True).over(w).alias("first"))
    return df.withColumn("so_far", so_far)


def prefix_trace(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "trace", *, last: int | None = None) -> DataFrame:
    """Adds the values of the sequence up to and with each frame: the `last` ones of them, at most as many as a picture of the
    trace shows. Without `last` all of them, which is quadratic in a sequence's length: for short ones alone."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return df.withColumn(out, F.collect_list(value).over(w))


def running_offset(df: DataFrame, keys: Sequence[str], order: str, size: str, out: str = "offset") -> DataFrame:
    """Adds the bytes of the rows before: where a row's blob starts in its sequence's file."""
    before = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))
