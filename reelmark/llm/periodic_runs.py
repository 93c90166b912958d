"""Periodic runs of words, by the runs theorem.

A run is a stretch of words with a smallest period that no neighbouring word extends. Every run holds a Lyndon root of its
period that is the longest Lyndon word starting at its place, under the order of the words or under the reverse one. The
longest Lyndon words end before the next smaller value of the inverse suffix array (the next larger one, for the reverse
order), so there are at most two candidates a word. A candidate is extended to both sides by longest common prefixes of two
suffixes: a minimum over the LCP array, from a sparse table; to the left, on the words in reverse.

Documents are taken many at a time, with separators of their own between them, smaller than every word; a separator occurs
once, so nothing reaches over it. A run as long as asked for repeats many words, so only documents that repeat that many words
get suffix arrays of their own; that test is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, without

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACE = r"[\x20\x09-\x0D]+"


def suffix_order(s: np.ndarray, most: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of s in order, and by level k a rank of each place that two places share if 2^k numbers from there on are
    alike. s ends in a number that occurs once, and so does every stretch that reaches its end.

    Doubling: in each round only places still level with another are sorted anew. With `most`, rounds end at 2^k >= most.
    """
    order = np.argsort(s, kind="stable")
    head = np.append(True, s[order[1:]] != s[order[:-1]])
    rank = np.empty(len(s), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    levels, h = [rank.astype(np.int32)], 1
    active = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(active) and not 0 < most <= h:
        at = order[active]
        key = rank[at] * len(s) + rank[at + h]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[active] = at
        head = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(head, active, 0))
        levels.append(rank.astype(np.int32))
        active = active[~(head & np.append(head[1:], True))]
        h *= 2
    return order, levels


class CommonPrefixes:
    """Lengths of the longest common prefixes of two suffixes: minima of the LCP array, from a sparse table."""

    def __init__(self, s: np.ndarray):
        order, levels = suffix_order(s)
        self.rank = levels[-1]
        i, j = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(len(s), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][i] == levels[k][j]
            step = same.astype(np.int32) << k
            i, j = i + step, j + step
            lcp[1:] += step
        self.table = [lcp]
        while 2 << (k := len(self.table) - 1) <= len(lcp):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - (1 << k)], last[1 << k :]))

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j that differ."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """The next place with a smaller value; the length of the list where there is none."""
    out, waiting = [len(values)] * len(values), []
    for i, x in enumerate(values):
        while waiting and values[waiting[-1]] > x:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def find_runs(s: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period), in this order, of every run of at least max(least, times * period) numbers; times is 2 at least.

    s begins and ends with a separator; separators are smaller than all other numbers, and each occurs once.
    """
    forward, backward = CommonPrefixes(s), CommonPrefixes(s[::-1].copy())
    n, found = len(s), []
    for ranks in (forward.rank, -forward.rank):
        after = next_smaller(ranks.tolist())
        i = np.flatnonzero(after < n)
        p = after[i] - i
        same = s[i] == s[i + p]
        i, p = i[same], p[same]
        r = forward.at(i, i + p)
        # The first root of a run starts within its first period.
        ok = r >= (times - 2) * p + 1
        i, p, end = i[ok], p[ok], (i + p + r)[ok]
        if not len(i):
            continue
        by = np.lexsort((i, p, end))
        i, p, end = i[by], p[by], end[by]
        first = np.append(True, (end[1:] != end[:-1]) | (p[1:] != p[:-1]))
        i, p, end = i[first], p[first], end[first]
        left = backward.at(n - i, n - i - p)
        start = i - left
        found.append(np.stack([start, end - start, p], axis=1)[end - start >= np.maximum(least, times * p)])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def runs_of_texts(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """find_runs() of the words of each text, starts counted from its own first word."""
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) + len(texts) + 1 for words in texts]
    # A run of period q repeats its words but the last q: least - least // times of them at least.
    repeated = max(1, least - least // times)
    block = 1 << (repeated.bit_length() - 1)
    some = [k for k, c in enumerate(codes) if len(c) >= max(least, times)]
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not some:
        return out

    def joined(chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts, each between separators, and where they begin."""
        sizes = np.array([len(codes[k]) + 1 for k in chosen])
        start = np.cumsum(sizes) - sizes + 1
        s = np.zeros(sizes.sum() + 1, np.int64)
        for k, at in zip(chosen, start.tolist(), strict=True):
            s[at : at + len(codes[k])] = codes[k]
        s[np.append(0, start + sizes - 1)] = np.arange(len(chosen) + 1)
        return s, start

    s, start = joined(some)
    levels = suffix_order(s, block)[1]
    if 1 << (len(levels) - 1) < block:
        return out
    # Places of one text alike in a block of words stand together when sorted by their rank, for a place's order in it is kept.
    rank = levels[block.bit_length() - 1]
    by = np.argsort(rank, kind="stable")
    text_of = np.searchsorted(start, by, "right")
    again = (rank[by[1:]] == rank[by[:-1]]) & (text_of[1:] == text_of[:-1])
    chosen = [some[k - 1] for k in np.unique(text_of[1:][again]).tolist() if k]
    if not chosen:
        return out
    s, start = joined(chosen)
    rows = find_runs(s, least, times)
    owner = np.searchsorted(start, rows[:, 0], "right") - 1
    rows[:, 0] -= start[owner]
    for k, own in zip(chosen, np.split(rows, np.searchsorted(owner, np.arange(1, len(chosen)))), strict=True):
        out[k] = own
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def collapse_runs(docs: DataFrame, *, least: int = 24, times: int = 3, text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Every column of docs plus n_words, runs and collapsed: the runs of at least `least` words and `times` periods, by start
    and period, and the text with each run cut down to its first period, its words joined by one space.

    Words are what stands between white space (ASCII). Null and empty texts have no words, no runs and an empty collapsed text.
    Runs may overlap; a word goes if any run drops it. Repeated rows each get their result, rows with nulls elsewhere too; an
    empty table gives no rows. Input columns of the added names, in any case, are replaced; all others stay, whatever their
    names. A text is taken whole, however long: a task holds one text's words and, if it repeats enough of them, some tens of
    numbers for each.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    docs = without(docs, "n_words", "runs", "collapsed")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
            bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // slice_bytes, prepend=-1)).tolist()
            for a, b in zip(bounds, [*bounds[1:], len(sizes)], strict=True):
                part = batch.slice(a, b - a)
                texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(at).to_pylist()]
                found = runs_of_texts(texts, least, times)
                kept = [b" ".join(w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r).tolist(), strict=True) if k]) for w, r in zip(texts, found, strict=True)]
                rows = np.concatenate(found)
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["start", "length", "period"]))
                new = [pa.array(list(map(len, texts)), pa.int64()), lists, pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return map_columns(docs, run, f"n_words bigint, runs {RUNS}, collapsed string")


def words(text: Column) -> Column:
    """A text's words, in the JVM."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeat_tail(words: Column, seed: Column) -> Column:
    """Words whose end is a repetition: every word from place seed % n on is one of the first p from there, again and again,
    where p is a third to a tenth of what follows, by seed. Without words, none."""
    n = F.size(words).cast("bigint")
    a = seed % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + seed % 8)).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))).otherwise(words)


def longest_repetition(runs: Column) -> Column:
    """The run with most periods, exactly compared; of equals the first. Null without runs."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUNS[len("array<") : -1]), lambda a, r: F.when(better(a, r), r).otherwise(a))
