"""Segmentation traces: which objects a frame shows, where the cup is, and whether it ended up on the saucer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CUP_WORDS, FRAME_WIDTH, PRESENT_SHARE, SAUCER_WORDS, SETTLED_MOVE
from ..functions import any_word, in_box, known, pad_box, ramp
from . import sequence as seq


def explode_frames(traces: DataFrame, *, keep: Sequence[str] = ("episode",), outer: bool = False) -> DataFrame:
    """A row per sampled frame: the kept columns, frame_idx (keys are text and become numbers), objects, prompts. A trace
    without frames has no row, or, if outer, one without frame_idx."""
    entries = traces.select(*keep, (F.explode_outer if outer else F.explode)(F.map_entries("frames")).alias("_f"))
    return entries.select(*keep, F.col("_f.key").cast("int").alias("frame_idx"), F.col("_f.value.objects").alias("objects"), F.col("_f.value.prompt_to_obj_ids").alias("prompt_to_obj_ids"))


def objects_of(objects: Column, prompts: Column, words: Sequence[str]) -> Column:
    """The objects whose id stands under a prompt that has one of the words in it."""
    named = F.map_filter(prompts, lambda prompt, _: any_word(prompt, words))
    ids = F.coalesce(F.flatten(F.map_values(named)), F.array().cast("array<int>"))
    return F.coalesce(F.filter(objects, lambda o: F.array_contains(ids, o["object_id"])), F.slice(objects, 1, 0))


def best_detection(objects: Column) -> Column:
    """The object of the highest score; of equals, the first; null without objects."""
    ranked = F.transform(objects, lambda o, i: F.struct(o["score"].alias("score"), (-i).alias("place"), o.alias("object")))
    return F.array_max(ranked)["object"]


def frame_tracks(frames: DataFrame, *, cup_words: Sequence[str] = CUP_WORDS, saucer_words: Sequence[str] = SAUCER_WORDS) -> DataFrame:
    """Adds to exploded frames: cup_x, cup_y (of the best cup that has a centre), box (of the best saucer, widened),
    saucer_x, saucer_y and cup_ids. All within the row."""
    cups = objects_of(F.col("objects"), F.col("prompt_to_obj_ids"), cup_words)
    out = frames.withColumns({"_cups": cups, "_saucer": best_detection(objects_of(F.col("objects"), F.col("prompt_to_obj_ids"), saucer_words))})
    out = out.withColumn("_cup", best_detection(F.filter("_cups", lambda o: F.size(o["centroid_xy"]) > 0)))
    b = [F.get(F.col("_saucer.box_xyxy"), i) for i in range(4)]
    there = F.col("_saucer").isNotNull()
    out = out.withColumns({
        "cup_x": F.get("_cup.centroid_xy", F.lit(0)), "cup_y": F.get("_cup.centroid_xy", F.lit(1)), "box": F.when(there, pad_box(*b)),
        "saucer_x": F.when(there, (b[0] + b[2]) / 2), "saucer_y": F.when(there, (b[1] + b[3]) / 2), "cup_ids": F.transform("_cups", lambda o: o["object_id"]),
    })
    return out.drop("_cups", "_cup", "_saucer")


def placement(frames: DataFrame, keys: Sequence[str], order: str, *, x: str = "cup_x", y: str = "cup_y", box: str = "box", width: float = FRAME_WIDTH, extra: Sequence[Column] = ()) -> DataFrame:
    """Per sequence: n, saucer_tracked, cup_present_end, cup_on_saucer, cup_displacement, cup_settled, seg_score, seg_mode.

    With a box anywhere in the sequence, seg_score is the share of the last quarter's frames whose point is in the
    box; a frame takes the latest box, before the first one the sequence's last, and a frame without a point counts
    as outside. Without any box it is a ramp over the distance between the mean points of first and last quarter.
    One shuffle.
    """
    part = seq.quarters(frames, keys, order).withColumn("_box", seq.carried_or_last(box, keys, order))
    seen = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = known(in_box(x, y, "_box") & seen).cast("double")
    last, first = F.col("in_last"), F.col("in_first")
    per = part.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.col(box).isNotNull()), F.lit(False)).alias("saucer_tracked"), F.avg(F.when(last, seen.cast("double"))).alias("cup_present_end"),
        F.avg(F.when(last, inside)).alias("_on"), *[F.avg(F.when(part_ & seen, F.col(c))).alias(a) for part_, c, a in ((last, x, "_x1"), (last, y, "_y1"), (first, x, "_x0"), (first, y, "_y0"))], *extra,
    )
    tracked = F.col("saucer_tracked")
    moved = F.coalesce(F.sqrt((F.col("_x1") - F.col("_x0")) * (F.col("_x1") - F.col("_x0")) + (F.col("_y1") - F.col("_y0")) * (F.col("_y1") - F.col("_y0"))) / width, F.lit(0.0))
    there = F.col("cup_present_end")
    per = per.withColumn("_moved", moved)
    fallback = ramp(F.col("_moved"), there)
    settled = ((there >= PRESENT_SHARE) & (F.col("_moved") >= SETTLED_MOVE)).cast("double")
    per = per.withColumns({
        "cup_on_saucer": F.when(tracked, F.col("_on")), "cup_displacement": F.when(~tracked, F.col("_moved")), "cup_settled": F.when(~tracked, settled),
        "seg_score": F.when(tracked, F.col("_on")).otherwise(fallback), "seg_mode": F.when(tracked, "cup_on_saucer").otherwise("cup_settled(fallback)"),
    })
    return per.drop("_on", "_x1", "_y1", "_x0", "_y0", "_moved")


def seg_features(traces: DataFrame, key: str = "episode", *, carry: str | None = None) -> DataFrame:
    """The placement features of segmentation traces, plus cup_track_ids, how many ids the cup had. An episode
    without frames has no row. Only ids that the frame before lacks are gathered: a few of an episode, not all its frames'.

    With `carry`, a column of the traces comes along (its largest value, of several traces of a key), and an episode without
    frames has a row with that column alone: the traces are read once for both.
    """
    before = F.lag("cup_ids").over(seq.ordered([key], "frame_idx"))
    new = F.array_except("cup_ids", F.coalesce(before, F.array().cast("array<int>")))
    keep = (key,) if carry is None else (key, carry)
    frames = frame_tracks(explode_frames(traces, keep=keep, outer=carry is not None)).withColumn("_new", new)
    ids = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("_new") > 0, F.col("_new")))))).alias("cup_track_ids")
    if carry is None:
        return placement(frames, [key], "frame_idx", extra=[ids])
    out = placement(frames, [key], "frame_idx", extra=[ids, F.max(carry).alias("_carried"), F.count("frame_idx").alias("_frames")])
    features = [F.when(F.col("_frames") > 0, F.col(c)).alias(c) for c in out.columns if c not in (key, "_carried", "_frames")]
    return out.select(key, F.col("_carried").alias(carry), *features)


def mask_summary(pixels: DataFrame, keys: Sequence[str], x: str, y: str, on: str) -> DataFrame:
    """(keys, area, centroid_x, centroid_y) of a row per pixel; a mask without a pixel has area 0 and no centre."""
    hit = F.coalesce(F.col(on).cast("boolean"), F.lit(False))
    return pixels.groupBy(*keys).agg(F.count_if(hit).alias("area"), F.avg(F.when(hit, F.col(x))).alias("centroid_x"), F.avg(F.when(hit, F.col(y))).alias("centroid_y"))
