"""Line deduplication with sharded minimal perfect hashes.

1. Each document's distinct line keys become 128-bit hashes: (doc_id, hi, lo), written once.
2. Grouped by hash (partial aggregation first): smallest document and number of documents.
3. Hashes are dealt into shards by their high bits. A shard's keys get a minimal perfect hash (hash and displace:
   a seed for each bucket of keys), which indexes three arrays: 32-bit fingerprints, document counts, first owners.
4. The documents' hashes go to the shards as probes and look up the arrays; lines are never joined with lines. A
   shard that many documents probe is split: its arrays, of bounded size, go to several groups of probes.
5. Lines to drop return to their document, which is rewritten in one pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_columns, parts, without, written

#: Marks a seed that is a slot's number.
NAMED = np.uint32(1 << 31)
STRIP = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased (bytes.lower leaves other letters)."""
    return line.strip(STRIP).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points: bytes that don't continue one."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _mixed(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = x ^ (np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys to 0..n-1.

    Keys fall into buckets of about two. Buckets are placed from the largest on; a bucket's seed is the first
    with which its keys meet free, different slots. Keys that are not distinct raise an error.
    """

    TRIES = 1 << 16

    def __init__(self, n: int, seeds: np.ndarray):
        self.n, self.seeds = n, seeds

    @classmethod
    def build(cls, keys: np.ndarray, load: int = 2) -> PerfectHash:
        n = len(keys)
        nb = max(1, n // load)
        seeds, free = np.zeros(nb, np.uint32), np.ones(n, bool)
        if not n:
            return cls(0, seeds)
        bucket = (_mixed(keys, 0xB) % np.uint64(nb)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=nb)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        # All buckets of one size try a seed together; those whose slots are free and met by no other are placed.
        for size in range(int(sizes.max()), 1, -1):
            todo = np.flatnonzero(sizes == size)
            own = keys[order[starts[todo][:, None] + np.arange(size)]]
            seed = 0
            while len(todo):
                if seed >= cls.TRIES:
                    raise ValueError("a bucket of keys finds no slots: are the keys distinct?")
                at = (_mixed(own.ravel(), seed) % np.uint64(n)).astype(np.int64).reshape(own.shape)
                cand = np.flatnonzero(free[at].all(axis=1))
                slots, first = np.unique(at[cand].ravel(), return_index=True)
                mine = np.zeros(len(cand) * size, bool)
                mine[first] = True  # the first to claim a slot has it
                won = cand[mine.reshape(-1, size).all(axis=1)]
                free[at[won].ravel()] = False
                seeds[todo[won]] = seed
                left = np.ones(len(todo), bool)
                left[won] = False
                todo, own, seed = todo[left], own[left], seed + 1
        # Keys alone in their bucket take the slots that are left, by number.
        seeds[np.flatnonzero(sizes == 1)] = NAMED | np.flatnonzero(free).astype(np.uint32)
        return cls(n, seeds)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; a key that was not built in gets any place."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        seed = self.seeds[(_mixed(keys, 0xB) % np.uint64(len(self.seeds))).astype(np.int64)]
        at = (_mixed(keys, seed.astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        named = seed >= NAMED
        if named.any():
            at[named] = (seed[named] ^ NAMED).astype(np.int64) % self.n
        return at


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc_id, hi, lo): the distinct keys of each document that are long enough."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not text:
                    continue
                own = {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if long_enough(k := line_key(line), least_chars)}
                ids.append(np.full(len(own), i, np.int64))
                hashes.append(b"".join(own))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "hi", "lo"])

    return docs.select(column(id_col).cast("bigint"), column(text_col).cast("binary")).mapInArrow(explode, "doc_id bigint, hi bigint, lo bigint")


def folded(hi: np.ndarray, lo: np.ndarray, fold: int) -> np.ndarray:
    """128-bit keys as 64-bit ones; which keys meet depends on fold."""
    return _mixed(hi, fold) ^ _mixed(lo, fold + 1000)


def perfect_fold(hi: np.ndarray, lo: np.ndarray, tries: int = 32) -> tuple[int, PerfectHash]:
    """A fold with which the distinct 128-bit keys stay distinct, and their perfect hash."""
    for fold in range(tries):
        keys = folded(hi, lo, fold)
        if len(np.unique(keys)) == len(keys):
            return fold, PerfectHash.build(keys)
    raise ValueError("the 128-bit keys are not distinct")


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, n_keys, n_probes, fold, seeds, prints, counts, owners) of (hi, lo, n_docs, owner) rows; a row per shard
    with keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = pdf["hi"].to_numpy(np.int64).view(np.uint64), pdf["lo"].to_numpy(np.int64).view(np.uint64)
        fold, ph = perfect_fold(hi, lo)
        at = ph.index(folded(hi, lo, fold))
        prints, n, owners = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int64)
        prints[at], n[at], owners[at] = (lo >> np.uint64(32)).astype(np.uint32), np.minimum(pdf["n_docs"].to_numpy(), 0xFFFFFFFF), pdf["owner"].to_numpy()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(hi)], "n_probes": [int(pdf["n_docs"].sum())], "fold": [fold], "seeds": [ph.seeds.tobytes()], "prints": [prints.tobytes()], "counts": [n.tobytes()], "owners": [owners.tobytes()]})

    keyed = counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandas(build, "shard int, n_keys bigint, n_probes bigint, fold int, seeds binary, prints binary, counts binary, owners binary")


def _probe(key: tuple, probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    if not len(probes) or not len(shard):
        return pd.DataFrame({"doc_id": [], "hi": [], "lo": []}).astype("int64")
    s = shard.iloc[0]
    ph = PerfectHash(int(s["n_keys"]), np.frombuffer(s["seeds"], np.uint32))
    hi, lo, doc = (probes[c].to_numpy(np.int64) for c in ("hi", "lo", "doc_id"))
    at = ph.index(folded(hi.view(np.uint64), lo.view(np.uint64), int(s["fold"])))
    same = np.frombuffer(s["prints"], np.uint32)[at] == (lo.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    drop = same & (np.frombuffer(s["counts"], np.uint32)[at] >= 2) & (np.frombuffer(s["owners"], np.int64)[at] != doc)
    return probes.loc[drop, ["doc_id", "hi", "lo"]]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, keys_a_shard: int = 250_000) -> DataFrame:
    """The documents with their repeated lines dropped: every input column, text rewritten, plus n_lines, n_dropped.

    A key of at least least_chars code points held by two documents or more stays only in the document with the
    smallest id; that one keeps all its lines. Null and empty texts are one empty line and come back as ''. Rows
    with a null id keep all lines and count for no other. Rows with one id, repeated ones too, are one document and are
    each rewritten. An empty table gives no rows. Columns of the added names, in any case, are replaced; all others stay,
    whatever their names.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    doc, drop = (f"_{x}_{uuid.uuid4().hex}" for x in ("doc", "drop"))
    hashes = written(line_hashes(docs, id_col, text_col, least_chars), "line-hashes")
    counts = written(hashes.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).select("hi", "lo", "owner", F.when(F.col("owner") == F.col("_last"), 1).otherwise(F.col("n")).alias("n_docs")), "line-counts")
    size = counts.agg(F.count("*"), F.sum("n_docs")).first()
    shards = max(2 * parts(spark), -(-size[0] // keys_a_shard))
    arrays = written(build_shards(counts, shards), "line-shards")
    # Groups a shard's probes are split into: as many as it has shares of the mean task's probes.
    share = max(1, (size[1] or 0) // (2 * parts(spark)))
    share = min(share, 2_000_000)
    groups = F.ceil(F.col("n_probes") / share).cast("int")
    # A small row per shard that is split. No hint: Spark broadcasts the table if it is small as written, else joins by shard.
    hot = written(arrays.select("shard", groups.alias("_g")).filter("_g > 1"), "hot-shards")
    arrays = arrays.withColumn("_g", groups).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    probes = hashes.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    probes = probes.join(hot, "shard", "left").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.coalesce("_g", F.lit(1))).cast("int"))
    drops = probes.select("shard", "sub", "doc_id", "hi", "lo").groupBy("shard", "sub").cogroup(arrays.drop("_g", "n_probes").groupBy("shard", "sub")).applyInPandas(_probe, "doc_id bigint, hi bigint, lo bigint")
    by_doc = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("hi", "lo")).alias(drop))
    return rewrite(docs.join(by_doc, column(id_col).cast("bigint") == F.col(doc), "left").drop(doc), drop, text_col, least_chars)


def rewrite(docs: DataFrame, drop_col: str, text_col: str, least_chars: int) -> DataFrame:
    """Drops the lines whose hash is in drop_col, which goes; adds n_lines and n_dropped."""
    at, gone_at = docs.columns.index(text_col), docs.columns.index(drop_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in drop}
                    lines = [x for x in lines if not (len(x) >= least_chars and long_enough(k := line_key(x.encode()), least_chars) and xxhash.xxh3_128_digest(k) in gone)]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[f"c{at}"] = pa.array(texts, pa.string())
            del cols[f"c{gone_at}"]
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*cols, "n_lines", "n_dropped"])

    return map_columns(docs, run, "n_lines bigint, n_dropped bigint", keep=lambda c: c != drop_col)


