"""Loading bulk frames into episodes, and picking what to load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import frame_cap, positions, stride_sample

from ..constants import DEFAULT_FPS


def episode_rate(frames: Column) -> Column:
    """Frames per second of an episode by the distance of its first two frame numbers, at a source rate of 30."""
    step = F.when(F.size(frames) > 1, F.get(frames, F.lit(1)) - F.get(frames, F.lit(0))).otherwise(30)
    return DEFAULT_FPS / F.greatest(F.lit(1), step)


def group_to_sequence(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """A row per group, each value column an array in the order of `order` (ties by the values)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    out = df.groupBy(*keys).agg(rows.alias("_rows"))
    return out.select(*keys, F.col(f"_rows.{order}").alias(order), *[F.col(f"_rows.{v}").alias(v) for v in values])


def pose_columns(columns: Sequence[str]) -> dict[str, str]:
    """The pose and gaze columns of a bulk table and the names they get."""
    return {c: c.replace("left_obs_", "left.obs_").replace("right_obs_", "right.obs_") for c in columns if c.endswith(("_pose", "_gaze"))}


def pad_ragged(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "rows") -> DataFrame:
    """(keys, width, out): per group the arrays of `value` in order, each filled up with nulls to the longest one's
    width. Groups whose arrays are all null or empty go. Each row's array is padded in the row, as wide as its group."""
    size = F.coalesce(F.size(value), F.lit(0))
    per = df.groupBy(*keys).agg(F.max(size).alias("width"), F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v")))).alias("_rows"))
    wide = F.transform("_rows", lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get(r["_v"], i)))
    return per.filter("width > 0").select(*keys, "width", wide.alias(out))


def checked_images(df: DataFrame) -> DataFrame:
    """Bulk frames as they are; the job fails where an image has no bytes."""
    return df.withColumn("image", F.when(F.col("image.bytes").isNotNull(), F.col("image")).otherwise(F.raise_error(F.concat(F.lit("an image without bytes in episode "), F.coalesce("episode", F.lit("null"))))))


def bulk_episodes(frames: DataFrame) -> DataFrame:
    """(episode, total_frames, fps, frames, images) of bulk frames."""
    seqs = group_to_sequence(checked_images(frames), ["episode"], "frame", ["image"])
    return seqs.select("episode", F.size("frame").alias("total_frames"), episode_rate(F.col("frame")).alias("fps"), F.col("frame").alias("frames"), F.col("image").alias("images"))


def sampled_frames(frames: DataFrame, episodes: DataFrame, key: str, order: str, *, stride: int = 1, most: int = 0) -> DataFrame:
    """Sampled frames with their place in the sample and their episode's attributes: every stride-th by `order`, which
    stays as the source index, the first `most` of them. The job fails at an episode of which no frame is left."""
    sampled = positions(frame_cap(stride_sample(frames, order, stride), [key], order, most), [key], order, pos="sample", n="n_sampled")
    whole = frames.select(key).distinct().join(sampled, key, "left").join(episodes, key, "left")
    checked = F.when(F.col("sample").isNotNull(), F.col("sample")).otherwise(F.raise_error(F.concat(F.lit("no frames sampled in episode "), F.col(key).cast("string"))).cast("int"))
    return whole.withColumn("sample", checked)


def clips_of(traces: DataFrame, clips: DataFrame, *, key: str = "episode", clip: str = "clip") -> DataFrame:
    """Every trace with the clip whose file's stem is its episode; null where there is none."""
    return traces.join(clips.withColumnRenamed(clip, key), key, "left")


def exactly_one(**given: object) -> str:
    """The name of the one option that is given; an error if none or several are."""
    names = [n for n, v in given.items() if v is not None]
    if len(names) != 1:
        raise ValueError(f"exactly one of {', '.join(sorted(given))} must be given, not {', '.join(names) or 'none'}")
    return names[0]


def skip_completed(todo: DataFrame, done: DataFrame, key: str, *, force: bool = False, complete: str | None = None) -> DataFrame:
    """The rows whose key isn't among those done; with `complete`, only rows marked so count as done; force skips none."""
    if force:
        return todo
    if complete:
        done = done.filter(F.col(complete) == F.lit(True))
    return todo.join(done.select(key).distinct(), key, "left_anti")


def missing_pairs(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct expected keys that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def starts_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with a prefix; an empty one keeps all."""
    return df.filter(F.col(column).startswith(prefix)) if prefix else df


def first_rows(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows in an order; 0 keeps all."""
    return df.orderBy(*order).limit(most) if most else df.orderBy(*order)
