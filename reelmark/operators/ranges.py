"""Running sums, neighbours and medians along groups of any size.

A plain window walks a whole group in one task. Here rows are dealt into ranges of their order, as many as there are
shuffle partitions; windows walk a range each, and what stands before a range comes from a table with a row per group
and range. The values that cut the ranges are approximate quantiles, few numbers that a first pass brings to the
driver; results don't depend on them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut_points(df: DataFrame, order: str, ranges: int | None = None) -> list:
    """Quantiles of a column of numbers or times, ascending, that cut it into `ranges` ranges of like numbers of rows;
    one that many rows have comes several times. A job runs here, while a query is made."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    return sorted(df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [])


def range_of(order: str, cuts: Sequence) -> Column:
    """The number of distinct cuts below a value, twice, and one more for a value that is itself several cuts: a value
    that many rows have is a range of its own. Ranges are in the order of the values; nulls are in the first."""
    once = sorted(set(cuts))
    if not once:
        return F.lit(0)
    often = [c for c, n in Counter(cuts).items() if n > 1]
    steps = F.lit([1 << k for k in reversed(range(len(once).bit_length()))])
    x, held = F.col(order), F.lit(once)
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < x, at + step).otherwise(at))
    return 2 * below + (F.coalesce(x.isin(often), F.lit(False)).cast("int") if often else 0)


def _dealt(df: DataFrame, keys: Sequence[str], order: str, tie: str | None, cuts: Sequence | None) -> DataFrame:
    """Adds _range, _tie and _chunk, the group's key with them (a struct, so that null keys meet). Only a range of one
    value is cut further, by `tie`."""
    cuts = cut_points(df, order) if cuts is None else cuts
    out = df.withColumns({"_range": range_of(order, cuts), "_tie": F.lit(0)})
    if tie and len(set(cuts)) < len(cuts):
        out = out.withColumn("_tie", F.when(F.col("_range") % 2 == 1, range_of(tie, cut_points(df, tie))).otherwise(0))
    return out.withColumn("_chunk", F.struct(*keys, "_range", "_tie"))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], *, tie: str | None = None, descending: bool = False, own: bool = True, cuts: Sequence | None = None) -> DataFrame:
    """Adds for each (name, value) of `sums` the sum of the values over the group's rows up to and with each row (without
    it, if not `own`), 0 where there are none, and as name_all the whole group's.

    Rows are taken by `order`, descending on request, rows of one order by `tie`, ascending; both are numbers or times.
    """
    dealt = _dealt(df, keys, order, tie, cuts)
    way = F.desc if descending else F.asc
    inside = Window.partitionBy("_chunk").orderBy(way(order), *([F.asc(tie)] if tie else [])).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    group = Window.partitionBy(*(f"_chunk.{k}" for k in keys))
    before = group.orderBy(way("_chunk._range"), F.asc("_chunk._tie")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_chunk").agg(*(F.sum(v).alias("_t_" + name) for name, v in sums.items()))
    zero = F.lit(0)
    totals = totals.select("_chunk", *(F.coalesce(F.sum("_t_" + s).over(before), zero).alias("_b_" + s) for s in sums), *(F.coalesce(F.sum("_t_" + s).over(group), zero).alias(s + "_all") for s in sums))
    walked = dealt.withColumns({"_w_" + name: F.coalesce(F.sum(v).over(inside), zero) for name, v in sums.items()})
    return walked.join(totals, "_chunk").select(*df.columns, *((F.col("_b_" + s) + F.col("_w_" + s)).alias(s) for s in sums), *(s + "_all" for s in sums))


def step_lengths(df: DataFrame, values: Sequence[str], keys: Sequence[str], order: str, out: str = "step") -> DataFrame:
    """Adds the Euclidean distance to the row before in the group; null for the first and beside missing values. The last
    row of each range is carried over to the next one."""
    point = F.struct(F.col(order).alias("_o"), *values)
    dealt = _dealt(df, keys, order, None, None).withColumn("_point", point)
    ends = dealt.groupBy("_chunk").agg(F.max("_point").alias("_end"))
    group = Window.partitionBy(*(f"_chunk.{k}" for k in keys)).orderBy("_chunk._range")
    ends = ends.select("_chunk", F.lag("_end").over(group).alias("_end"))
    walked = dealt.withColumn("_lag", F.lag("_point").over(Window.partitionBy("_chunk").orderBy("_point"))).join(ends, "_chunk")
    was = F.coalesce("_lag", "_end")
    squares = ((F.col(v) - was[v]) * (F.col(v) - was[v]) for v in values)
    return walked.select(*df.columns, F.sqrt(sum(squares, F.lit(0.0))).alias(out))


def median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """One row: the exact median of a column of numbers, as a double; null without any. Equal values are counted first."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    cuts = cut_points(rows, "_v")
    ranked = running_sums(rows.groupBy("_v").agg(F.count("*").alias("_c")), [], "_v", {"_upto": "_c"}, cuts=cuts)
    middle = ranked.filter("_upto >= (_upto_all + 1) div 2 and _upto - _c < _upto_all div 2 + 1")
    return middle.agg(F.avg("_v").alias(out))
