"""Hierarchical packing into sequences of several lengths.

Documents are cut into windows of the largest size; what is left of one, or a shorter document, goes to the tier of the smallest
context size that holds it. Tiers are packed from the longest down: a sequence begins with the longest piece of its tier, and
its gap is filled from pieces that are shorter: exactly by one or two of them if there are such, else by the longest that
fits; if nothing fits, a piece is cut and its tail stays to be packed. So every sequence is full but at most one, and as a
full sequence is as long as its tier, only that one is padded.

Sequences of one tier make step groups of equally many tokens each, and the groups of all tiers follow one another in turn,
each tier spread evenly over all steps.

As in exact-complement packing, the plan depends on how many pieces there are of each length alone, and a piece finds its
places from its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, parts, written
from .packing import encoded

PARTS = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary"
TIERS = (256, 512, 1024, 2048)


def token_parts(docs: DataFrame, tokenizer_path: str, *, size: int, end_id: int, id_col: str, text_col: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """Each document's ids and then end_id, in windows of `size` ids and what is left: (doc_id, start, length, doc_tokens,
    ids_crc32, ids). A full window is not cut any more, so its ids are left out; the others' take two bytes each if they can."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in encoded(batches, tokenizer_path, end_id, slice_bytes):
            out: list[tuple] = []
            for i, tokens in texts:
                n = len(tokens)
                for at in range(0, n, size):
                    own = tokens[at : at + size]
                    ids = None if len(own) == size else (own.astype(np.uint16) if own.max() < 1 << 16 else own).tobytes()
                    out.append((i, at, len(own), n, zlib.crc32(own.tobytes()), ids))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).mapInArrow(cut, PARTS)


class Step(NamedTuple):
    """`times` sequences of a tier, alike in their lengths: (length of the piece, how many, how much of each is taken)."""

    tier: int
    times: int
    members: list[tuple[int, int, int]]


def _filling(have: np.ndarray, first: int, tier: int) -> list[tuple[int, int, int]]:
    """What a sequence that begins with a piece of length `first` is filled with, and the pieces it takes, itself included."""
    left = have.copy()
    left[first] -= 1
    chosen, gap = [(first, first)], tier - first

    def take(length: int, used: int) -> int:
        left[length] -= 1
        chosen.append((length, used))
        return gap - used

    while gap > 0:
        if left[gap]:
            gap = take(gap, gap)
            continue
        low = np.arange(1, gap // 2 + 1)
        pair = low[(left[low] > 0) & (left[gap - low] > (low == gap - low))]
        fits = np.flatnonzero(left[:gap])
        if len(pair):
            gap = take(gap - int(pair[-1]), gap - int(pair[-1]))
        elif len(fits):
            gap = take(int(fits[-1]), int(fits[-1]))
        else:
            longer = np.flatnonzero(left[gap + 1 :])
            if not len(longer):
                break
            gap = take(int(longer[-1]) + gap + 1, gap)
    return [(length, chosen.count((length, used)), used) for length, used in dict.fromkeys(chosen)]


def tier_steps(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> list[Step]:
    """Steps that place every piece, from the longest tier down. Of the pieces of one length those cut off others come last."""
    size = tiers[-1]
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    steps = []
    for low, tier in zip([0, *tiers[:-1]][::-1], tiers[::-1], strict=True):
        while len(own := np.flatnonzero(have[low + 1 : tier + 1])):
            members = _filling(have, int(own[-1]) + low + 1, tier)
            needed: dict[int, int] = {}
            for length, k, _ in members:
                needed[length] = needed.get(length, 0) + k
            times = min(int(have[length]) // k for length, k in needed.items())
            for length, k, used in members:
                have[length] -= times * k
                have[length - used] += times * k * (used < length)
            steps.append(Step(tier, times, members))
    return steps


class Layout(NamedTuple):
    """By length of a piece, rows (first rank, ranks, start in the piece, length, copies before, copies a sequence, first
    sequence, offset, tier): each is a part of the pieces of these ranks. By tier, its first sequence and their number."""

    rows: dict[int, np.ndarray]
    sequences: dict[int, tuple[int, int]]


def layout(steps: list[Step], counts: dict[int, int], tiers: Sequence[int] = TIERS) -> Layout:
    """The places of the steps' pieces. Sequences are numbered tier by tier."""
    number = {t: sum(s.times for s in steps if s.tier == t) for t in tiers}
    base = {t: sum(number[u] for u in tiers if u > t) for t in tiers}
    # By length, what waits: (length of the whole piece, first rank, ranks, start in the piece).
    waiting: dict[int, deque] = {length: deque([(length, 0, n, 0)]) for length, n in counts.items() if n}
    rows: dict[int, list[tuple]] = {}
    after = dict(base)
    for tier, times, members in steps:
        offset = 0
        for length, k, used in members:
            needed, before, own = times * k, 0, waiting[length]
            while before < needed:
                whole, rank, n, start = own.popleft()
                now = min(n, needed - before)
                if now < n:
                    own.appendleft((whole, rank + now, n - now, start))
                rows.setdefault(whole, []).append((rank, now, start, used, before, k, after[tier], offset, tier))
                if used < length:
                    waiting.setdefault(length - used, deque()).append((whole, rank, now, start + used))
                before += now
            offset += k * used
        after[tier] += times
    return Layout({length: np.array(r, np.int64) for length, r in rows.items()}, {t: (base[t], number[t]) for t in tiers if number[t]})


def step_groups(index: np.ndarray, tier: int, groups: dict[int, int], a_group: int) -> np.ndarray:
    """The step of sequences by their index in a tier: the tier's group i of n stands at (i + 1/2) / n of all steps."""
    i, n = index // a_group, groups[tier]
    out = i.copy()
    for t, m in groups.items():
        if t != tier:
            # Groups j of the other tier with (2 j + 1) / m before (2 i + 1) / n; of equals, those of the longer tier.
            at = (2 * i + 1) * m - n
            out += np.clip(at // (2 * n) + 1 if t > tier else -(-at // (2 * n)), 0, m)
    return out


def pack_tiers(pieces: DataFrame, *, tiers: Sequence[int] = TIERS, step_tokens: int = 16_384, rows_a_task: int = 1_000_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group) of the parts of `token_parts` rows."""
    tiers = sorted(tiers)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # as many rows as the largest size at most
    places = layout(tier_steps(counts, tiers), counts, tiers)
    groups = {t: -(-n // max(1, step_tokens // t)) for t, (_, n) in places.sequences.items()}
    n = max(parts(pieces.sparkSession), -(-sum(counts.values()) // rows_a_task))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("int"))
    inside = Window.partitionBy("_bucket", "length").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_bucket", "length").count().select("_bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1).join(first, ["_bucket", "length"]).select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("_first") + F.col("_rn")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths, ranks, found = pdf["length"].to_numpy(), pdf["_rank"].to_numpy(), []
            for length in np.unique(lengths).tolist():
                own, table = np.flatnonzero(lengths == length), places.rows[length]
                at = ranks[own]
                piece, row = np.nonzero((at[:, None] >= table[:, 0]) & (at[:, None] < table[:, 0] + table[:, 1]))
                found.append(np.column_stack([own[piece], at[piece], table[row]]))
            p, rank, low, _, start, length, done, k, sequence, offset, tier = np.concatenate(found).T
            copy = done + rank - low
            whole, crc, ids = length == lengths[p], pdf["ids_crc32"].to_numpy()[p], pdf["ids"].to_numpy()
            for j in np.flatnonzero(~whole).tolist():
                data = np.frombuffer(ids[p[j]], np.uint16 if len(ids[p[j]]) == 2 * lengths[p[j]] else np.uint32)
                crc[j] = zlib.crc32(data[start[j] : start[j] + length[j]].astype(np.uint32).tobytes())
            out = pdf[["doc_id", "start", "doc_tokens"]].iloc[p].reset_index(drop=True)
            out["start"] += start
            group = np.zeros(len(p), np.int64)
            for t, (base, _) in places.sequences.items():
                mine = tier == t
                group[mine] = step_groups((sequence + copy // k)[mine] - base, t, groups, max(1, step_tokens // t))
            yield out.assign(length=length, ids_crc32=crc, sequence_id=sequence + copy // k, offset=offset + copy % k * length, tier=tier, step_group=group)

    return ranked.mapInPandas(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint")


def pack_in_tiers(docs: DataFrame, tokenizer_path: str, *, tiers: Sequence[int] = TIERS, end_id: int = 1, step_tokens: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes whole documents once and packs them into sequences as long as the tiers: (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, tier, step_group). A step group is step_tokens tokens of one tier, the last of a tier fewer.

    Null and empty texts are end_id alone. Rows with a null id are packed under it, and repeated rows give their pieces each;
    which of several equal pieces (a tie) takes which place is open, but every place is taken once. An empty table gives no
    rows. Extra columns, of whatever name, are ignored. A very long text is tokenized in one task and cut into windows there.
    All sequences are full but one at most, which is the last of its tier.
    """
    tiers = sorted(tiers)
    if not tiers or tiers[0] < 1:
        raise ValueError("tiers are positive sizes")
    return pack_tiers(written(token_parts(docs, tokenizer_path, size=tiers[-1], end_id=end_id, id_col=id_col, text_col=text_col), "parts"), tiers=tiers, step_tokens=step_tokens)
