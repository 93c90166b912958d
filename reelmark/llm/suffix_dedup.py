"""Removal of long byte strings that an earlier document also has, with logarithmic families of suffix arrays.

A string of `length` bytes has a minimizer: the smallest hash among its 16-byte substrings. Equal strings have
equal minimizers, so only places whose minimizer occurs in two different texts can hold a repeat, and all equal
strings meet in one shard.

1. Copies of whole texts are found by 128-bit digests; each is removed against its smallest document and takes no
   further part.
2. Minimizers travel as packed blocks to hash buckets; those of a single text fall away.
3. Around the minimizers that are left, documents send contexts: runs of bytes whose suffixes start at places
   with that minimizer. They are dealt into shards by minimizer and sorted by document.
4. A shard takes its contexts batch by batch in order of documents. A batch gets a suffix array (its suffixes
   sorted by their first `length` bytes), which is merge-scanned against each existing level; suffixes not yet held
   become a new level, and levels of like size merge, so a shard has logarithmically many. Levels hold a suffix
   once, with its first document, whatever the number of copies.
5. Covered ranges return to their documents, which are rewritten in one pass.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, parts, written

U = np.uint64
GRAM = 16
RUN = 64
VARIANT = 40


def minimizers(data: bytes, length: int) -> np.ndarray:
    """For each start of a string of `length` bytes, the smallest hash of its 16-byte substrings."""
    n, w = len(data) - GRAM + 1, length - GRAM + 1
    if n < w:
        return np.zeros(0, U)
    words = np.empty(len(data) - 7, U)
    for k in range(8):
        own = np.frombuffer(data, U, (len(data) - k) // 8, k)
        words[k::8] = own[: len(words[k::8])]
    h = (words[:n] * U(0x9E3779B97F4A7C15)) ^ (words[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F))
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes. Suffixes are compared by their first `length` bytes."""

    def __init__(self, length: int):
        self.length, self.levels, self.known = length, [], {}

    def add(self, contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
        """Adds a batch, documents ascending and none before those of earlier batches. Returns for each context the
        smallest document that holds the suffix at each of its places."""
        length = self.length
        distinct: dict[bytes, int] = {}
        which = np.array([distinct.setdefault(c, len(distinct)) for c in contexts], np.int64)
        first = docs[np.unique(which, return_index=True)[1]]
        sizes = np.array([len(c) - length + 1 for c in distinct], np.int64)
        spans = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(distinct), np.uint8)
        offsets = np.cumsum(sizes + length - 1) - (sizes + length - 1)
        starts = np.repeat(offsets - spans[:-1], sizes) + np.arange(spans[-1])
        suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[starts].copy().view(f"S{length}").ravel()
        # The batch's suffix array, equal suffixes once, with the first document.
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        keys, group = ordered[new], np.cumsum(new) - 1
        owner = np.minimum.reduceat(np.repeat(first, sizes)[order], np.flatnonzero(new))
        fresh = np.ones(len(keys), bool)
        for held, whose in self.levels:
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            same = held[at] == keys
            owner[same] = np.minimum(owner[same], whose[at[same]])
            fresh &= ~same
        if fresh.any():
            self.levels.append((keys[fresh], owner[fresh]))
            while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
                (k2, o2), (k1, o1) = self.levels.pop(), self.levels.pop()
                at = np.searchsorted(k1, k2)
                self.levels.append((np.insert(k1, at, k2), np.insert(o1, at, o2)))
        by_suffix = np.empty(len(order), np.int64)
        by_suffix[order] = owner[group]
        return [by_suffix[spans[k] : spans[k + 1]] for k in which]


def _anchor_blocks(docs: DataFrame, length: int, seed: int, buckets: int) -> DataFrame:
    """(bucket, block): distinct minimizers of each text with the text's mark, packed; copies near each other are sent
    once, and the buckets tell other repeats apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()  # the texts sent last
        for batch in batches:
            values, index, marks = [], [], []
            for text in batch.column(0).to_pylist():
                if not text or len(text) < length:
                    continue
                mark = _digest(text, seed)[0]
                if mark in seen:
                    seen.move_to_end(mark)
                    continue
                seen[mark] = None
                if len(seen) > 1_000_000:
                    seen.popitem(last=False)
                m = minimizers(text, length)
                own = np.unique(m[np.concatenate([[True], m[1:] != m[:-1]])])
                values.append(own)
                index.append(np.full(len(own), len(marks), np.int32))
                marks.append(mark)
            out_b, out_d = [], []
            if values:
                v, i, marks = np.concatenate(values), np.concatenate(index), np.array(marks, np.int64).view(U)
                bucket = ((v * U(0x9FB21C651E98DF25)) >> U(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                for b in np.flatnonzero(np.diff(cuts)):
                    o = order[cuts[b] : cuts[b + 1]]
                    held, local = np.unique(i[o], return_inverse=True)
                    out_b.append(int(b))
                    out_d.append(b"".join([np.array([len(held), len(o)], np.int64).tobytes(), marks[held].tobytes(), v[o].tobytes(), local.astype(np.int32).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_d, pa.binary())], names=["bucket", "block"])

    return docs.select("text").mapInArrow(run, "bucket int, block binary")


def _shared_anchors(blocks: DataFrame) -> DataFrame:
    """(mark, n, anchors): for each text, its minimizers of this bucket that another text has too."""

    def run(table: pa.Table) -> pa.Table:
        vs, ms = [], []
        for b in table.column("block").to_pylist():
            m, n = np.frombuffer(b, np.int64, 2)
            marks, v, local = np.frombuffer(b, U, m, 16), np.frombuffer(b, U, n, 16 + 8 * m), np.frombuffer(b, np.int32, n, 16 + 8 * m + 8 * n)
            vs.append(v)
            ms.append(marks[local])
        v, m = np.concatenate(vs), np.concatenate(ms)
        order = np.lexsort((m, v))
        v, m = v[order], m[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (m[1:] != m[:-1])
        v, m = v[first], m[first]
        same = v[1:] == v[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        v, m = v[more], m[more]
        order = np.argsort(m, kind="stable")
        v, m = v[order], m[order]
        cuts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(m))[: len(cuts)]
        return pa.table({"mark": pa.array(m[cuts].view(np.int64)), "n": pa.array((ends - cuts).astype(np.int64)), "anchors": pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(run, "mark bigint, n bigint, anchors binary")


def _contexts(docs: DataFrame, length: int, seed: int, shards: int) -> DataFrame:
    """(shard, doc_id, pos, data) of documents with a list of shared anchors: runs of up to 64 suffix starts of one
    minimizer, with the bytes their suffixes need. The place of a text among the several of its id is in pos, from
    bit VARIANT on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                ids, pos, shard, data = [], [], [], []
                for i, text, lists, variants in zip(*(some.column(k).to_pylist() for k in range(4)), strict=True):
                    if not lists or len(text or b"") < length:
                        continue
                    base = variants.index(_digest(text, seed)[0]) << VARIANT if variants else 0
                    m = minimizers(text, length)
                    shared = np.sort(np.concatenate([np.frombuffer(x, U) for x in lists]))
                    change = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    values = m[change]
                    at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
                    keep = shared[at] == values
                    starts, ends, values = change[keep], np.append(change[1:], len(m))[keep], values[keep]
                    for s, e, h in zip(starts.tolist(), ends.tolist(), ((values >> U(17)) % U(shards)).tolist(), strict=True):
                        for a in range(s, e, RUN):
                            ids.append(i)
                            pos.append(base + a)
                            shard.append(h)
                            data.append(text[a : min(a + RUN, e) + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), pa.array(data, pa.binary())], names=["shard", "doc_id", "pos", "data"])

    return docs.mapInArrow(run, "shard int, doc_id bigint, pos bigint, data binary")


def _scan(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, first, last): byte ranges that strings of smaller documents cover. Takes rows sorted by shard and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, None
        for batch in batches:
            shard, docs, pos = (batch.column(k).to_numpy() for k in range(3))
            data = batch.column(3).to_pylist()
            out: list[list] = [[], [], []]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[a] != now:
                    now, levels = shard[a], SuffixLevels(length)
                for k, owner in zip(range(a, b), levels.add(data[a:b], docs[a:b]), strict=True):
                    hit = owner < docs[k]
                    if hit.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                        out[0] += [int(docs[k])] * (len(edge) // 2)
                        out[1] += (edge[::2] + pos[k]).tolist()
                        out[2] += (edge[1::2] + (pos[k] + length - 1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "first", "last"])

    return contexts.mapInArrow(run, "doc_id bigint, first bigint, last bigint")


def _rewrite(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, ranges, of, variants in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                text = text or b""
                mark = _digest(text, seed)[0] if (of or variants) and len(text) >= length else None
                if of and mark in of:
                    runs = [(0, len(text))]
                else:
                    runs = []
                    # The ranges of this text alone; no other can be of a text that is too short for any.
                    base = variants.index(mark) << VARIANT if variants and mark is not None else 0
                    own = [] if len(text) < length else [(r["first"] - base, r["last"] - base) for r in ranges or () if r["first"] >> VARIANT == base >> VARIANT]
                    for a, b in sorted(own):
                        if runs and a <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                        else:
                            runs.append((a, b))
                n.append(len(text))
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"first": a, "last": b} for a, b in runs])
                ends = [0, *(b for _, b in runs)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)], strict=True)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first bigint, last bigint>>, kept binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchors_a_bucket: int = 2_000_000, places_a_shard: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per row: UTF-8 bytes covered by a `length`-byte string that also
    starts in a document with a smaller id go; spans are the removed ranges [first, last).

    Null texts are empty, and texts shorter than `length` lose nothing, however long the others are. Of copies (a tie) the
    smallest id keeps its text. Rows of one id, repeated ones too, are one document to others and are each rewritten;
    rows with a null id neither count nor return. An empty table gives no rows. Extra columns, of whatever name, are
    ignored. A very long text is cut into runs of places for the shards; it is whole in the tasks that cut and rewrite it.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    docs = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).cast("binary").alias("text")).filter("doc_id is not null")
    texts = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # About one distinct minimizer in 17 bytes.
    buckets = int(max(2 * parts(spark), texts // (17 * anchors_a_bucket)))
    for seed in range(16):
        keys = written(_marks(docs.filter(F.length("text") >= length), seed), "marks")
        marks = written(keys.groupBy("mark").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c"), (F.min("check") < F.max("check")).alias("mixed")), "owners")
        if marks.filter("mixed").isEmpty():  # else two different texts have one mark: others with the next seed
            break
    marks = marks.drop("mixed")
    shared = written(_shared_anchors(_anchor_blocks(docs, length, seed, buckets)), "anchors")
    copies = keys.join(marks.filter("c > 1"), "mark").filter("doc_id <> owner").groupBy(F.col("doc_id").alias("copy")).agg(F.collect_set("mark").alias("of"))
    # Ids with rows of different texts, if there are any: their marks in order.
    several = keys.groupBy("doc_id").agg(F.sort_array(F.collect_set("mark")).alias("variants")).filter(F.size("variants") > 1).withColumnRenamed("doc_id", "_v")
    several = written(several, "several")
    lists = shared.join(marks, "mark").groupBy("owner").agg(F.collect_list("anchors").alias("lists"))
    places = 17 * (shared.agg(F.sum("n")).first()[0] or 0)
    shards = int(max(4 * parts(spark), places // places_a_shard))
    tasks = int(max(parts(spark), shards // 4))
    # Both joins below read one exchange of the documents by id.
    with_lists = docs.join(lists, F.col("doc_id") == F.col("owner"), "left").join(several, F.col("doc_id") == F.col("_v"), "left").select("doc_id", "text", "lists", "variants")
    dealt = _contexts(with_lists, length, seed, shards).repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", "pos")
    ranges = _scan(dealt, length).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).withColumnRenamed("doc_id", "_r")
    out = docs.join(ranges, F.col("doc_id") == F.col("_r"), "left").join(copies, F.col("doc_id") == F.col("copy"), "left").join(several, F.col("doc_id") == F.col("_v"), "left")
    return _rewrite(out.select("doc_id", "text", "ranges", "of", "variants"), length, seed)


def _digest(text: bytes, seed: int) -> tuple[int, int]:
    """Two signed halves of a text's 128-bit digest: its mark, and what tells texts of one mark apart."""
    both = np.frombuffer(xxhash.xxh3_128_digest(text, seed), np.int64)
    return int(both[0]), int(both[1])


def _marks(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, mark, check) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([_digest(t, seed) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "mark", "check"])

    return docs.mapInArrow(run, "doc_id bigint, mark bigint, check bigint")
