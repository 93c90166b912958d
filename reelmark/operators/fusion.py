"""Fusing independent signals of an episode into one verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SUCCESS, TAG_THRESHOLD
from ..functions import mean_present, tag_above, tag_from
from .evaluation import consensus, votes
from .ranges import median


def spine(signals: dict[str, DataFrame], key: str) -> DataFrame:
    """The full outer join of any number of signals with a row per key: (key, a struct column per signal).

    Signals are stacked and grouped, one shuffle however many there are; a key's record is null where the signal
    lacks it. Of several records of one key, the largest counts.
    """
    def only(name: str, df: DataFrame) -> DataFrame:
        record = F.struct(*[c for c in df.columns if c != key])
        return df.select(key, *[(record if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in signals])

    kinds = {n: df.select(F.struct(*[c for c in df.columns if c != key]).alias("r")).schema["r"].dataType for n, df in signals.items()}
    rows = None
    for name, df in signals.items():
        rows = only(name, df) if rows is None else rows.unionByName(only(name, df))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(n).alias(n) for n in signals])


def calibration(df: DataFrame, late: str, default: float = TAG_THRESHOLD) -> DataFrame:
    """One row (threshold): the exact median of the scores, the default without any."""
    return median(df, late).select(F.coalesce("median", F.lit(default)).alias("threshold"))


def with_threshold(df: DataFrame, threshold: DataFrame | float) -> DataFrame:
    """Adds the threshold to every row: a number, or the one row of calibration()."""
    if isinstance(threshold, int | float):
        return df.withColumn("threshold", F.lit(float(threshold)))
    return df.withColumn("threshold", threshold.select("threshold").scalar())


def calibrated_score(late: Column, threshold: Column) -> Column:
    """Half for being above the threshold, half for how far the score gets to twice the threshold; with a threshold
    of 0 or less, the score itself."""
    step = F.when(late > threshold, 0.5).otherwise(0.0)
    reach = F.least(F.lit(1.0), late / F.greatest(F.lit(1e-9), 2 * threshold))
    return F.when(late.isNull(), None).when(threshold > 0, step + 0.5 * reach).otherwise(late)


def calibrated_fusion(df: DataFrame, *, late: str, seg: str, any_hold: str, threshold: DataFrame | float, seg_threshold: float = TAG_THRESHOLD) -> DataFrame:
    """Adds threshold, pred_vlm, pred_seg, fused_score, pred_fused.

    The fused score is the mean of the signals there are; it is 0 if the gripper record says that nothing was ever
    held. A missing record vetoes nothing.
    """
    out = with_threshold(df, threshold)
    mean = mean_present(calibrated_score(F.col(late), F.col("threshold")), F.col(seg))
    fused = F.when(mean.isNotNull() & (F.col(any_hold) == F.lit(False)), 0.0).otherwise(mean)
    return out.withColumns({"pred_vlm": tag_above(late, F.col("threshold")), "pred_seg": tag_from(seg, seg_threshold), "fused_score": fused}).withColumn("pred_fused", tag_from("fused_score"))


def verdicts(scores: DataFrame, seg: DataFrame, *, key: str, model: str = "model", score: str = "score", seg_score: str = "seg_score") -> DataFrame:
    """(key, seg_score, vlm_mean, n_models, final, tag, votes): of a row per episode and model, and a row per episode.

    final is the mean of the box score and the models' mean, of those there are. A vote is a score of 0.5 or more.
    Both tables are stacked and grouped: one shuffle, any number of models.
    """
    rows = scores.select(key, F.lit(False).alias("_seg"), F.col(score).alias("_x")).unionByName(seg.select(key, F.lit(True).alias("_seg"), F.col(seg_score).alias("_x")))
    x, is_seg = F.col("_x"), F.col("_seg")
    out = rows.groupBy(key).agg(
        F.max(F.when(is_seg, x)).alias("seg_score"), F.avg(F.when(~is_seg, x)).alias("vlm_mean"), F.count(F.when(~is_seg, x)).alias("n_models"),
        F.count_if(x >= TAG_THRESHOLD).alias("_yes"), F.count(x).alias("_votes"),
    )
    out = out.withColumn("final", mean_present("seg_score", "vlm_mean"))
    return out.select(key, "seg_score", "vlm_mean", "n_models", "final", tag_from("final").alias("tag"), votes(F.col("_yes"), F.col("_votes")).alias("votes"))


def consensus_of(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """(keys, n_success, n_votes, consensus, votes) of tagged rows."""
    ns, n = F.count_if(F.col(tag) == SUCCESS), F.count(tag)
    return df.groupBy(*keys).agg(ns.alias("n_success"), n.alias("n_votes"), consensus(ns, n).alias("consensus"), votes(ns, n).alias("votes"))


def first_record(fields: dict[str, str]) -> Column:
    """A field of the first signal that has a record, {signal: field}: null if that record's is, whatever others say."""
    out = F.lit(None)
    for signal, field in reversed(fields.items()):
        out = F.when(F.col(signal).isNotNull(), F.col(f"{signal}.{field}")).otherwise(out)
    return out
