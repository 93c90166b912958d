"""Plugging a model in: frames go to it in Arrow batches, an error of one episode is a row and stops no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FrameScorer(Protocol):
    """A model that gives a probability for each frame of one episode."""

    def score(self, task: str, frames: list[bytes]) -> list[float]: ...


#: One scorer per worker and factory.
_LOADED: dict[str, FrameScorer] = {}


def fill_prompt(template: str, task: Column | str) -> Column:
    """A question about a task: the template with {task} filled in."""
    parts = template.split("{task}")
    task = F.coalesce(F.col(task) if isinstance(task, str) else task, F.lit(""))
    pieces = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [task, F.lit(p)]
    return F.concat(*pieces)


def short_prompt(question: Column | str) -> Column:
    """The last line of a question, as a prompt for models that answer in one word."""
    return F.concat(F.lit("answer en "), F.element_at(F.split(question, "\n"), -1))


def score_episodes(episodes: DataFrame, make: Callable[[], FrameScorer], *, name: str) -> DataFrame:
    """(episode, p_yes, error) of rows (episode, task, frames array<binary>).

    make() is called once per worker. An exception becomes the row's error, with p_yes null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = make()
        scorer = _LOADED[name]
        for batch in batches:
            out = []
            for episode, task, frames in zip(batch["episode"], batch["task"], batch["frames"], strict=True):
                try:
                    if frames is None or not len(frames):
                        raise ValueError("no frames")
                    out.append((episode, [float(x) for x in scorer.score(task or "", [bytes(f) for f in frames])], None))
                except Exception as e:  # noqa: BLE001  the error is the result
                    out.append((episode, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["episode", "p_yes", "error"])

    return episodes.select("episode", "task", "frames").mapInPandas(run, "episode string, p_yes array<double>, error string")


def score_frames(frames: DataFrame, make: Callable[[], FrameScorer], *, name: str, batch: int = 32) -> DataFrame:
    """(episode, frame_idx, p_yes, error) of rows (episode, frame_idx, task, image): a row per frame.

    Frames come to a worker sorted by episode and frame, and to the model `batch` at a time, across the borders of episodes, so
    a task holds one batch of them, however long an episode is. make() is called once per worker. A model may have
    score_batch(tasks, images); else score(task, images) is called for each episode of a batch.

    If a batch fails, its episodes are scored one by one. An episode that fails, or has a frame without image, gets the error on
    that stretch and on all its later frames, which the model doesn't see any more; no other episode loses a frame.
    """
    rows = frames.select(F.col("episode").cast("string").alias("episode"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.coalesce("task", F.lit("")).alias("task"), "image")
    rows = rows.repartition("episode").sortWithinPartitions("episode", "frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:
            _LOADED[name] = make()
        scorer = _LOADED[name]
        failed: tuple[str | None, str | None] = (None, None)  # the latest episode that failed: no earlier one comes again

        def scored(some: list[tuple]) -> list[float]:
            if hasattr(scorer, "score_batch"):
                out = list(scorer.score_batch([task for _, _, task, _ in some], [image for *_, image in some]))
            else:
                out = [p for _, own in groupby(some, key=itemgetter(0)) for own in [list(own)] for p in scorer.score(own[0][2], [image for *_, image in own])]
            if len(out) != len(some):
                raise ValueError(f"{len(out)} scores of {len(some)} frames")
            return [float(p) for p in out]

        def results(some: list[tuple]) -> Iterator[tuple]:
            nonlocal failed
            fine = [r for r in some if r[0] != failed[0]]
            try:
                if any(image is None for *_, image in fine):
                    raise ValueError("a frame without image")
                p = scored(fine) if fine else []
                both = {id(r): x for r, x in zip(fine, p, strict=True)}
                yield from ((r[0], r[1], both.get(id(r)), None if id(r) in both else failed[1]) for r in some)
            except Exception as e:  # noqa: BLE001  the error is the result
                parts = [list(own) for _, own in groupby(some, key=itemgetter(0))]
                if len(parts) > 1:
                    for own in parts:
                        yield from results(own)
                else:
                    failed = (some[0][0], f"{type(e).__name__}: {e}")
                    yield from ((r[0], r[1], None, failed[1]) for r in some)

        def emitted(some: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*results(some), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["episode", "frame_idx", "p_yes", "error"])

        waiting: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                waiting += zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)
                while len(waiting) >= batch:
                    yield emitted(waiting[:batch])
                    del waiting[:batch]
        if waiting:
            yield emitted(waiting)

    return rows.mapInArrow(run, "episode string, frame_idx bigint, p_yes double, error string")


def frame_curves(scored: DataFrame) -> DataFrame:
    """(episode, p_yes, error) of score_frames(): the curve in order of frames, or the first error with no curve."""
    curve = F.array_sort(F.collect_list(F.struct("frame_idx", "p_yes")))["p_yes"]
    error = F.min(F.when(F.col("error").isNotNull(), F.struct("frame_idx", "error")))["error"]
    per = scored.groupBy("episode").agg(curve.alias("p_yes"), error.alias("error"))
    return per.select("episode", F.when(F.col("error").isNull(), F.col("p_yes")).alias("p_yes"), "error")


def run_counters(results: DataFrame) -> DataFrame:
    """(total, ok, failed) of score_episodes()."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def pack_masks(pixels: DataFrame, keys: Sequence[str], *, y: str = "y", x: str = "x", on: str = "on") -> DataFrame:
    """(keys, height, width, mask) of a row per pixel: rows of bits, high bit first, the last byte filled up with zeros.

    A missing pixel is off, and so is one whose `on` is null; rows of one pixel are on if one of them is. Bits are put together
    in the JVM: pixels are summed up to bytes before they are shuffled, and a mask is its bytes in order with the gaps between
    them as runs of zeros, so the work is linear in the pixels and bytes.
    """
    size = pixels.groupBy(*keys).agg((F.max(y) + 1).cast("bigint").alias("height"), (F.max(x) + 1).cast("bigint").alias("width"))
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    lit = pixels.filter(F.col(on)).select(*renamed, F.col(y).alias("_y"), F.col(x).alias("_x"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    at = F.col("_y") * F.col("width") + F.col("_x")
    lit = lit.join(size, reduce(and_, same, F.lit(True))).select(*keys, F.floor(at / 8).cast("int").alias("_byte"), F.get(F.array(*(F.lit(128 >> i) for i in range(8))), (at % 8).cast("int")).alias("_bit"))
    found = lit.groupBy(*keys, "_byte").agg(F.bit_or("_bit").alias("_bits"))
    byte = F.struct("_byte", F.lpad(F.hex("_bits"), 2, "0").alias("_hex"))
    rows = found.select(*keys, byte.alias("_b")).unionByName(size.select(*keys, F.lit(None).cast("struct<_byte:int,_hex:string>").alias("_b"), "height", "width"), allowMissingColumns=True)
    per = rows.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"), F.array_sort(F.collect_list("_b")).alias("_bytes"))
    n = F.ceil(F.col("height") * F.col("width") / 8).cast("int")
    gap = lambda b, i: F.repeat(F.lit("00"), b["_byte"] - F.when(i > 0, F.get("_bytes", i - 1)["_byte"]).otherwise(-1) - 1)
    text = F.array_join(F.transform("_bytes", lambda b, i: F.concat(gap(b, i), b["_hex"])), "")
    rest = F.repeat(F.lit("00"), n - 1 - F.coalesce(F.get("_bytes", F.size("_bytes") - 1)["_byte"], F.lit(-1)))
    return per.select(*keys, "height", "width", F.unhex(F.concat(text, rest)).alias("mask"))


def unpack_masks(masks: DataFrame, *, packed: str = "mask", height: str = "height", width: str = "width") -> DataFrame:
    """Adds area, centroid_x, centroid_y of bit-packed masks (rows of bits, high bit first); no centre without a pixel.

    Bits are taken apart by numpy, a mask at a time in Arrow batches: Spark's functions have no bits of binaries.
    """
    import numpy as np

    @F.pandas_udf("area bigint, centroid_x double, centroid_y double")
    def summary(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for b, hh, ww in zip(data, h, w, strict=True):
            if b is None:
                rows.append((0, None, None))
                continue
            bits = np.unpackbits(np.frombuffer(b, np.uint8), count=int(hh) * int(ww)).reshape(int(hh), int(ww))
            y, x = np.nonzero(bits)
            rows.append((len(x), float(x.mean()) if len(x) else None, float(y.mean()) if len(y) else None))
        return pd.DataFrame(rows, columns=["area", "centroid_x", "centroid_y"])

    return masks.withColumn("_s", summary(packed, height, width)).select(*masks.columns, "_s.*")
