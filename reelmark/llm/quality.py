"""A quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its words and character n-grams, hashed into a fixed number of
buckets; a softmax layer gives the classes. Vectors and layer are trained together by stochastic gradient descent
on a bounded sample. With two classes the layer is linear in the mean, so a bucket's vector and the layer fold
into one number per bucket, which is all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_columns, without

BITS = 18
MULT = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPAN = 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return ((h * MULT[7]) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None, grams: tuple[int, ...] = (3, 4)) -> np.ndarray:
    """Bucket numbers, with repeats, of the words, word pairs and n-grams that don't reach over white space.

    White space counts as one bounding space, so an n-gram knows where its word starts or ends. Very long texts
    are taken span by span, cut at white space where there is any.
    """
    out, at = [], 0
    text = text or ""
    while at < len(text):
        end = at + SPAN
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        out.append(_features(text[at:end], grams))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _features(text: str, grams: tuple[int, ...]) -> np.ndarray:
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    cp = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    c, space = cp.astype(np.uint64), cp == 32
    at = np.flatnonzero(space)
    # A word's hash is a polynomial of its characters, from prefix sums that wrap.
    powers = _powers(len(c))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers[0][: len(c)])])
    word = (sums[at[1:]] - sums[at[:-1] + 1]) * powers[1][at[:-1]]
    # Pairs of neighbouring words by the difference of their hashes: a word repeated is one bucket, whichever it is.
    out = [_bucket(word * MULT[6]), _bucket((word[1:] - word[:-1]) * MULT[5])]
    for n in grams:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(n):
            h = (h + c[k : k + m]) * MULT[k]
            if 0 < k < n - 1:
                inner |= space[k : k + m]
        out.append(_bucket(h[~inner]))
    return np.concatenate(out)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SPAN + 2)
        base = int(MULT[0])
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS


def drawn(buckets: np.ndarray, counts: np.ndarray, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the buckets with their counts, in order; which ones is as good as random, and depends on the seed."""
    if len(buckets) <= most:
        return buckets, counts
    mixed = (buckets.astype(np.uint64) + np.uint64(seed * int(MULT[1]) % 2**64)) * MULT[2]
    kept = np.sort(np.argpartition((mixed ^ (mixed >> np.uint64(29))) * MULT[3], most)[:most])
    return buckets[kept], counts[kept]


def sample_features(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 6000, buckets: int = 4096) -> list[tuple]:
    """(label, buckets, weights) of a bounded sample: the `rows` labelled training ids with the smallest hashes, and of each
    text `buckets` of its distinct buckets at most, drawn by a hash with the id in it. So the driver gets 8 * buckets bytes
    a row and no more, 197 MB as it is, however long the texts.

    Of an id with several labels the larger counts, of an id with several texts the one of the smallest hash; so `rows` is
    a bound whatever repeats. Null ids and labels other than 0 and 1 teach nothing, nor do texts without a word. An empty
    table gives an empty sample. Only the named columns are read, whatever others are called.
    """
    chosen = labels.filter(train & column(label_col).isin(0, 1) & column(id_col).isNotNull()).groupBy(column(id_col).cast("bigint").alias("_id")).agg(F.max(column(label_col)).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [drawn(*np.unique(features(t), return_counts=True), i, buckets) for t, i in zip(pdf["_text"], pdf["_id"], strict=True)]
            yield pd.DataFrame({"label": pdf["_label"], "id": pdf["_id"], "buckets": [b.astype(np.int32).tobytes() for b, _ in found], "counts": [c.astype(np.float32).tobytes() for _, c in found]})

    # The chosen rows are at most `rows` ids.
    joined = docs.select(column(id_col).cast("bigint").alias("_id"), column(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    joined = joined.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    got = joined.mapInPandas(extract, "label int, id bigint, buckets binary, counts binary").collect()
    out = []
    for label, i, b, c in sorted((tuple(r) for r in got), key=lambda r: (r[1], r[2], r[3])):
        weights = np.frombuffer(c, np.float32)
        if len(weights):
            out.append((label, np.frombuffer(b, np.int32), weights / weights.sum()))
    return out


def train_model(sample: list[tuple], *, dims: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 1) -> np.ndarray:
    """One logit per bucket, and the bias last. Without rows of both classes, the classes' share alone."""
    rng = np.random.default_rng(seed)
    ys = np.array([s[0] for s in sample])
    share = (ys.sum() + 1) / (len(ys) + 2)
    vectors = (rng.random((1 << BITS, dims), np.float32) - 0.5) / dims
    layer, bias = np.zeros((2, dims), np.float32), np.array([0, np.log(share / (1 - share))], np.float32)
    if not 0 < ys.sum() < len(ys):
        return np.append(np.zeros(1 << BITS, np.float32), np.float32(bias[1]))
    steps, done = epochs * len(sample), 0
    for _ in range(epochs):
        for k in rng.permutation(len(sample)):
            y, buckets, weights = sample[k]
            own = vectors[buckets]
            mean = weights @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - done / steps)
            back = layer.T @ p
            layer -= lr * np.outer(p, mean)
            bias -= 0.05 * lr * p
            vectors[buckets] = own - (lr * len(weights) ** 0.5) * np.outer(weights, back)
            done += 1
    return np.append(vectors @ (layer[1] - layer[0]), bias[1] - bias[0]).astype(np.float32)


def score(docs: DataFrame, model: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """Every column of docs plus quality_score, the probability of label 1.

    Null and empty texts get the bias alone. Repeated rows are each scored; an empty table gives no rows. An input column
    quality_score, in any case, is replaced; all others stay, whatever their names.
    """
    docs = without(docs, "quality_score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = shared.value[:-1], float(shared.value[-1])
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                f = features(text)
                z = bias + (float(logits[f].mean(dtype=np.float64)) if len(f) else 0.0)
                out.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return map_columns(docs, run, "quality_score double")
