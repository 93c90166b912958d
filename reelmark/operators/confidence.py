"""Confidence curves: statistics of per-frame yes-probabilities, and how a model's outputs become one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence as seq


def curve_statistics(curve: Column | str) -> dict[str, Column]:
    """p_done_late, p_done_final, p_done_max and p_done_rise of an array of probabilities; null if it is null or empty.

    Late is the mean of the last quarter (one frame at least), rise is late minus the mean of the first quarter.
    """
    p = F.filter(F.col(curve) if isinstance(curve, str) else curve, lambda x: x.isNotNull())
    n = F.size(p)
    q = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / q

    late = mean(F.slice(p, -q, q))
    some = {"p_done_late": late, "p_done_final": F.get(p, n - 1), "p_done_max": F.array_max(p), "p_done_rise": late - mean(F.slice(p, F.lit(1), q))}
    return {k: F.when(n > 0, v) for k, v in some.items()}


def add_curve_statistics(traces: DataFrame, curve: str = "p_yes") -> DataFrame:
    """Adds the statistics of each trace's curve: a projection, no shuffle."""
    return traces.withColumns(curve_statistics(curve))


def frame_statistics(frames: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The same statistics of curves with a row per frame: (keys, n, four statistics). One shuffle."""
    part = seq.quarters(frames, keys, order)
    late, early = F.avg(F.when(F.col("in_last"), F.col(value))), F.avg(F.when(F.col("in_first"), F.col(value)))
    return part.groupBy(*keys).agg(F.count("*").alias("n"), late.alias("p_done_late"), F.max_by(value, "pos").alias("p_done_final"), F.max(value).alias("p_done_max"), (late - early).alias("p_done_rise"))


def yes_from_logits(logits: Column | str, yes: Sequence[int], no: Sequence[int]) -> Column:
    """p(yes) of a vocabulary's logits: the softmax mass of the yes tokens over that of both; 0.5 if both have none."""
    x = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))

    def mass(ids: Sequence[int]) -> Column:
        return sum((F.coalesce(F.exp(F.get(x, i).cast("double") - top), F.lit(0.0)) for i in ids), F.lit(0.0)) / F.nullif(total, F.lit(0.0))

    both = mass(yes) + mass(no)
    return F.when(both < 1e-9, 0.5).otherwise(mass(yes) / F.nullif(both, F.lit(0.0)))


def yes_from_logprobs(tokens: DataFrame, keys: Sequence[str], token: str = "token", logprob: str = "logprob", yes: Sequence[str] = ("yes",), no: Sequence[str] = ("no",)) -> DataFrame:
    """(keys, p_yes, unresolved): of rows of top tokens, stripped and lower-cased. Unresolved, p_yes 0.5, if neither
    word is among them."""
    word, p = F.lower(F.trim(token)), F.exp(logprob)
    sums = tokens.groupBy(*keys).agg(F.coalesce(F.sum(F.when(word.isin(*yes), p)), F.lit(0.0)).alias("_y"), F.coalesce(F.sum(F.when(word.isin(*no), p)), F.lit(0.0)).alias("_n"))
    both = F.col("_y") + F.col("_n")
    return sums.select(*keys, F.when(both < 1e-9, 0.5).otherwise(F.col("_y") / F.nullif(both, F.lit(0.0))).alias("p_yes"), (both < 1e-9).alias("unresolved"))


def surface_ids(vocabulary: DataFrame, words: Sequence[str], piece: str = "piece", token_id: str = "id") -> DataFrame:
    """(ids): the sorted distinct ids of vocabulary pieces that are one of the words, with or without a leading space."""
    surfaces = [s for w in words for s in (w, " " + w)]
    return vocabulary.filter(F.col(piece).isin(surfaces)).agg(F.array_sort(F.collect_set(token_id)).alias("ids"))


def top_tokens(rows: DataFrame, keys: Sequence[str], token: str, score: str, k: int = 5) -> DataFrame:
    """The k best tokens of each group, rank from 1, ties by token."""
    w = seq.Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(token))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def class_gap(df: DataFrame, label: str, statistics: Sequence[str]) -> DataFrame:
    """(statistic, success_mean, failure_mean, gap) over labelled rows."""
    long = df.filter(F.col(label).isin("success", "failure")).unpivot([label], list(statistics), "statistic", "value")
    s, f = (F.avg(F.when(F.col(label) == x, F.col("value"))) for x in ("success", "failure"))
    return long.groupBy("statistic").agg(s.alias("success_mean"), f.alias("failure_mean"), (s - f).alias("gap"))
