"""Approximate nearest neighbours with learned partitions.

1. Equal vectors become one class with its smallest ids; no more of them can be among a query's nearest.
2. A bounded sample of classes gets an exact neighbour graph, which is cut into equal parts with few cut edges:
   recursive bisection, each half split at the median of a spectral coordinate and refined by swaps that cut fewer
   edges.
3. A small network of one hidden layer learns, from a vector, the parts of the vector and its graph neighbours.
4. Every class is indexed under its most probable partition. A query goes to its most probable partitions, as many
   as held-out vectors of the sample need to find the wanted share of their neighbours.
5. There, true distances rank all vectors of the partition. Large partitions and large groups of queries are split,
   so that a task's share is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, written


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By inner products: quick, with rounding errors."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        d = squared_distances(x[at : at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of len(nodes) nodes, as booleans: edges (a, b) run between positions."""
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + 1.0

    def pull(v: np.ndarray) -> np.ndarray:
        return np.bincount(a, weights=v[b], minlength=n)

    v = rng.standard_normal(n)
    for _ in range(60):  # towards the second eigenvector of the walk on the graph
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (pull(v) + v) / degree
        v /= np.abs(v).max() + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(30):
        other = pull(side.astype(float))
        own = np.bincount(a, minlength=n)
        gain = np.where(side, own - 2 * other, 2 * other - own)  # edges cut less if the node changes sides
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not good:
            break
        # Swapped nodes may be neighbours; a part of them at a time, and back if the cut doesn't shrink.
        m = max(1, good // 2)
        cut = (side[a] != side[b]).sum()
        trial = side.copy()
        trial[left[:m]], trial[right[:m]] = True, False
        if (trial[a] != trial[b]).sum() >= cut:
            break
        side = trial
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part numbers 0..parts-1 of the graph's rows, sizes equal but for one; parts is a power of two."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    out = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        halves = np.zeros(n, np.int64)
        for p in np.unique(out):
            nodes = np.flatnonzero(out == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (out[a] == p) & (out[b] == p)
            if len(nodes) > 1:
                halves[nodes] = _bisect(nodes, place[a[inside]], place[b[inside]], rng)
        out = 2 * out + halves
    return out


@dataclass
class Router:
    """Partition probabilities of vectors by a network of one hidden layer."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = (x - self.mean) * self.scale
        return np.maximum(h @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(sample: np.ndarray, parts: int, *, k: int = 10, wanted: float = 0.95, hidden: int = 128, steps: int = 2000, rate: float = 0.1, seed: int = 3) -> Router:
    """A router of a sample of distinct vectors; every ninth is held out to choose the number of probes."""
    held = np.arange(len(sample)) % 9 == 8
    x, y = sample[~held], sample[held]
    mean = x.mean(0) if len(x) else np.zeros(sample.shape[1])
    scale = 1 / (float((x - mean).std()) + 1e-12) if len(x) else 1.0
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    r = Router(mean, scale, rng.standard_normal((d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden), np.zeros((hidden, parts)), np.zeros(parts), parts)
    if len(x) < 2:
        return r
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, parts, seed)
    onehot = np.eye(parts)
    target = 0.5 * onehot[part] + 0.5 * onehot[part[graph]].mean(1)
    h = (x - mean) * scale
    weights = (r.w1, r.b1, r.w2, r.b2)
    speed = [np.zeros_like(w) for w in weights]
    done = 0
    while done < steps:
        order = rng.permutation(len(h))
        for at in range(0, len(h), 64):
            some = order[at : at + 64]
            z1 = h[some] @ r.w1 + r.b1
            a1 = np.maximum(z1, 0)
            z = a1 @ r.w2 + r.b2
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - target[some]) / len(some)
            back = (p @ r.w2.T) * (z1 > 0)
            if done == steps:
                break
            for w, s, g in zip(weights, speed, (h[some].T @ back, back.sum(0), a1.T @ p, p.sum(0)), strict=True):
                s *= 0.9
                s -= rate * (1 - done / steps) * (g + 1e-4 * w)
                w += s
            done += 1
    # Rank, among a held-out vector's partitions, of the one that holds each of its nearest in the sample.
    if len(y):
        near = np.argsort(squared_distances(y, x), axis=1)[:, :k]
        where = np.argmax(r.logits(x), axis=1)[near]
        rank = np.argsort(np.argsort(-r.logits(y), axis=1), axis=1)
        found = np.bincount(np.take_along_axis(rank, where, 1).ravel(), minlength=parts).cumsum() / where.size
        r.probes = int(np.argmax(found >= wanted)) + 1
    return r


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector of finite components, not all zero."""
    v = F.transform(column(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 to 0.0
    inf = float("inf")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)
    return vectors.select(column(id_col).cast("bigint").alias("id"), v.alias("v")).filter("id is not null").filter(F.coalesce(fine, F.lit(False)))


def vector_classes(vectors: DataFrame, *, id_col: str, vector_col: str, ids_each: int) -> DataFrame:
    """(v, ids, h): the distinct vectors that take part, the smallest ids of each, and a hash.

    Vectors that are null, empty, zero or hold null or non-finite components take none, nor do those of another length
    than the commonest (of equals, the shortest); rows of one id count once, with its smallest vector; null ids are left
    out.
    """
    rows = taking_part(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d").first()
    rows = rows.filter(F.size("v") == (length[0] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))
    # Row numbers are cut before the shuffle too, so a common vector sends ids_each rows from a task.
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("rn") <= ids_each)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v"))


def _sample(classes: DataFrame, n: int, rows: int) -> np.ndarray:
    """At most `rows` of the n classes, by hash."""
    span = 1 << 30
    share = min(span, -(-2 * rows * span // max(n, 1)))
    got = classes.filter(F.pmod("h", F.lit(span)) < share).orderBy("h").limit(rows).select("v").collect()
    return np.array([r[0] for r in got], float)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_a_partition: int = 36, most_partitions: int = 512, wanted: float = 0.97, least_probes: int = 1, rows_a_group: int = 8192, queries_a_group: int = 2048) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest found of each query among all other ids, by Euclidean distance
    in double precision, nearest first, ties to the smaller id.

    is_query is a condition on `id`. There are about sqrt(n) partitions, a power of two from 2 to most_partitions; they and
    the router are learned from sample_a_partition distinct vectors a partition (2304 at least), every vector is indexed.
    A query goes to least_probes partitions, to as many as held-out vectors need for the wanted share of their neighbours,
    and to as many as hold k others; with least_probes of all partitions the search is exact.
    Null ids, and vectors that are null, zero, not finite or of another length than the commonest, take no part. Rows that
    repeat an id count once, with the smallest vector. An empty table, or queries without other vectors, give no rows.
    Extra columns, of whatever name, are ignored.
    """
    classes = written(vector_classes(vectors, id_col=id_col, vector_col=vector_col, ids_each=k + 1), "classes")
    n, length = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = 2
    while parts < most_partitions and parts * parts < n:
        parts *= 2
    sample = _sample(classes, n, max(2304, sample_a_partition * parts)) if n else np.zeros((0, 1))
    router = classes.sparkSession.sparkContext.broadcast(train_router(sample, parts, k=k, wanted=wanted))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            p = np.argmax(router.value.logits(x), axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32))], names=["v", "ids", "h", "p"])

    placed = written(classes.mapInArrow(assign, "v array<double>, ids array<bigint>, h bigint, p int"), "placed")
    # A row per partition, of which there are most_partitions at most.
    held = {r[0]: (r[1], r[2]) for r in placed.groupBy("p").agg(F.count("*"), F.sum(F.size("ids"))).collect()}
    ids_in = np.array([held.get(p, (0, 0))[1] for p in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        probes = max(r.probes, least_probes)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(-r.logits(x), axis=1) if batch.num_rows else np.zeros((0, parts), np.int64)
            enough = (np.cumsum(ids_in[order], axis=1) <= k).sum(axis=1) + 1  # k others beside the query's own row
            p = [o[: max(probes, e)] for o, e in zip(order.astype(np.int32), enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.list_(pa.int32()))], names=["id", "v", "ps"])

    # A query among more copies than a class lists is found by its own row.
    asked = taking_part(vectors, id_col, vector_col).filter(is_query).filter(F.size("v") == (length or 0)).groupBy("id").agg(F.min("v").alias("v"))
    routed = written(asked.mapInArrow(route, "id bigint, v array<double>, ps array<int>"), "routed").select("id", "v", F.explode("ps").alias("p"))
    queries = {r[0]: r[1] for r in routed.groupBy("p").count().collect()}
    split = [(p, max(1, -(-c // rows_a_group)), max(1, -(-queries.get(p, 0) // queries_a_group))) for p, (c, _) in held.items()]
    splits = F.broadcast(classes.sparkSession.createDataFrame(split, "p int, subs int, qsubs int"))
    # Each query meets each vector of its partitions once: vectors are dealt over subs, queries over qsubs.
    base = placed.join(splits, "p").select("p", F.pmod("h", "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("qsubs") - 1)).alias("qsub"), "v", "ids")
    probe = routed.join(splits, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("id"), "qsubs").cast("int").alias("qsub"), "id", "v")

    def rerank(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _rerank(q, b, k)

    near = probe.groupBy("p", "sub", "qsub").cogroup(base.groupBy("p", "sub", "qsub")).applyInPandas(rerank, "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _rerank(q: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(q) and len(b):
        x, ids = np.stack(b["v"].to_list()), b["ids"].to_list()
        y, own = np.stack(q["v"].to_list()), q["id"].to_numpy()
        last = min(k, len(x) - 1)  # one class more than k: the query's own may hold nothing else
        for at in range(0, len(y), 256):
            some = y[at : at + 256]
            d = squared_distances(some, x)
            bound = np.partition(d, last, axis=1)[:, last] * (1 + 1e-9) + 1e-9 * (1 + (some**2).sum(1))
            for i in range(len(some)):
                # Differences give the exact figures; the bound keeps all that rounding could move.
                c = np.flatnonzero(d[i] <= bound[i])
                true = np.sqrt(((x[c] - some[i]) ** 2).sum(1))
                me = int(own[at + i])
                found = sorted((t, int(v)) for t, j in zip(true.tolist(), c.tolist(), strict=True) for v in ids[j] if v != me)[:k]
                out += [(me, v, t) for t, v in found]
    return pd.DataFrame({"query_id": [o[0] for o in out], "id": [o[1] for o in out], "distance": [o[2] for o in out]}).astype({"query_id": "int64", "id": "int64", "distance": "float64"})
