"""Splitting a long sequence into attempts: rests of an object, and what happens between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_REST_S, REST_SPEED, SCORE_WINDOW_S
from ..functions import in_box, known, mean_present, tag_from
from . import sequence as seq


def rounded_frames(seconds: float, dt: Column | str) -> Column:
    """Frames of a time at a frame's length, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(seconds) / (F.col(dt) if isinstance(dt, str) else dt)).cast("int"))


def motion(frames: DataFrame, keys: Sequence[str], order: str, *, x: str = "cup_x", y: str = "cup_y", ref_x: str = "saucer_x", ref_y: str = "saucer_y", box: str = "box", dt: str = "dt", speed: float = REST_SPEED) -> DataFrame:
    """Adds still and inside. Motion is relative to a reference object, so a moving camera cancels out; where either is
    missing it is unknown, and taken as still. A frame's box is the latest one; without a point or a box, inside is null."""
    out = frames.withColumns({"_rx": F.col(x) - F.col(ref_x), "_ry": F.col(y) - F.col(ref_y)})
    pace = seq.step_length(["_rx", "_ry"], keys, order) / F.col(dt)
    out = out.withColumns({"still": F.coalesce(pace < speed, F.lit(True)), "_box": seq.carried(box, keys, order)})
    return out.withColumn("inside", in_box(x, y, "_box").cast("double")).drop("_rx", "_ry", "_box")


def rests(frames: DataFrame, keys: Sequence[str], order: str, *, still: str = "still", inside: str = "inside", score: str | None = None, at: str | None = None, dt: str = "dt", least_s: float = MIN_REST_S, window_s: float = SCORE_WINDOW_S) -> DataFrame:
    """(keys, rest_start, rest_end, on, seg, vlm, start_at, last_at, dt) of every run of still frames that is long enough.

    on: the mean of the known inside values is 0.5 or more. seg and vlm are means over the first window of the rest,
    unknown values left out. start_at and last_at are the times of the first and last frame.
    """
    pos = frames.withColumn("_pos", F.row_number().over(seq.ordered(keys, order)) - 1).filter(F.coalesce(F.col(still), F.lit(False)))
    run = pos.withColumn("_run", F.col("_pos") - F.row_number().over(seq.ordered(keys, order)))
    run = run.withColumn("_in", F.row_number().over(seq.ordered([*keys, "_run"], "_pos")) <= rounded_frames(window_s, dt))
    when = F.col(at if at else order)
    value = F.col(score) if score else F.lit(None).cast("double")
    out = run.groupBy(*keys, "_run").agg(
        F.min("_pos").alias("rest_start"), (F.max("_pos") + 1).alias("rest_end"), known(F.avg(inside) >= 0.5).alias("on"), F.avg(F.when(F.col("_in"), F.col(inside))).alias("seg"),
        F.avg(F.when(F.col("_in"), value)).alias("vlm"), F.min_by(when, "_pos").alias("start_at"), F.max_by(when, "_pos").alias("last_at"), F.max(dt).alias("dt"),
    )
    return out.filter(F.col("rest_end") - F.col("rest_start") >= rounded_frames(least_s, "dt")).drop("_run")


def transitions(rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every rest with the next one of its sequence (next), and kind: attempt if it starts off the target, return if on."""
    w = seq.ordered(keys, "rest_start")
    nxt = F.lead(F.struct("rest_start", "rest_end", "on", "seg", "vlm", "start_at")).over(w)
    return rest.withColumn("next", nxt).filter(F.col("next").isNotNull()).withColumn("kind", F.when(F.col("on"), "return").otherwise("attempt"))


def attempts(rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, attempt, start_at, settle_at, carry_s, seg, vlm, tag, start_pos, settle_pos): the transitions that start
    off the target, numbered. The tag is that of the mean of the ending rest's scores there are; null without any."""
    moves = transitions(rest, keys).filter(F.col("kind") == "attempt")
    out = moves.withColumn("attempt", F.row_number().over(seq.ordered(keys, "rest_start")))
    carry = (F.col("next.rest_start") - F.col("rest_end") + 1) * F.col("dt")
    return out.select(
        *keys, "attempt", F.col("last_at").alias("start_at"), F.col("next.start_at").alias("settle_at"), carry.alias("carry_s"), F.col("next.seg").alias("seg"), F.col("next.vlm").alias("vlm"),
        tag_from(mean_present("next.seg", "next.vlm")).alias("tag"), (F.col("rest_end") - 1).alias("start_pos"), F.col("next.rest_start").alias("settle_pos"),
    )
