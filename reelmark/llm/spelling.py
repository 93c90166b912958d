"""Spelling variants: words one edit apart, by Aho-Corasick automata over their halves.

One edit leaves a half of a word as it is: its first half still begins the other word, or its second half still ends it. So
automata hold the two segments of every word, and every word is scanned: a segment found counts if it stands at the word's
start (first halves) or end (second halves) and the lengths of the two words differ by one at most; the words are then compared,
those that met in one segment all at once.

The segments are dealt over shards by what they say, and a word is sent to those shards alone that may hold one of its
segments: lengths that fit leave two possible first halves and two second ones. A segment that very many words have is
dealt over several shards, each of which scans the words that may have it. What a shard finds for a word is summed up there, so
no pair of words leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, parts, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """The maximal runs of Latin letters (with U+00C0 to U+00FF), A-Z lower-cased; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def without_one(word: Column, at: Column) -> Column:
    """The word without the code point at a place, counted from 0."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def word_counts(words: DataFrame, *, word_col: str = "word", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the words of at least `least_length` code points that come up at least `least_count` times. A row is a place
    where a word stands; places are counted before rows are shuffled, so a common word is no hot key. Nulls are no words."""
    words = words.select(F.col(word_col).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row of each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of code points, which of a and which of b are exactly one edit apart; b may be wider or narrower by one."""
    short = min(a.shape[1], b.shape[1])
    ahead = a[:, None, :short] == b[None, :, :short]
    if a.shape[1] == b.shape[1]:
        return ahead.sum(2) == short - 1
    behind = a[:, None, a.shape[1] - short :] == b[None, :, b.shape[1] - short :]
    alike = np.logical_and.accumulate(ahead, 2).sum(2) + np.logical_and.accumulate(behind[:, :, ::-1], 2).sum(2)
    return alike >= short


class Halves:
    """An automaton over halves: side 0 begins its word, side 1 ends it."""

    #: Up to so many pairs of one segment are compared one by one, more of them by columns; and numbers held by the latter.
    FEW, CELLS = 32, 4_000_000

    def __init__(self, held: Iterable[tuple[int, str, str, int]]):
        from ahocorasick import Automaton

        self.owners: dict[str, dict[tuple[int, int], list[tuple[str, int]]]] = {}
        for side, segment, word, n in held:
            self.owners.setdefault(segment, {}).setdefault((int(side), len(word)), []).append((word, n))
        self.automaton = Automaton()
        for segment, by in self.owners.items():
            for own in by.values():
                own.sort(key=lambda x: (-x[1], x[0]))
            self.automaton.add_word(segment, (len(segment), segment))
        if self.owners:
            self.automaton.make_automaton()

    def near(self, words: Iterable[str]) -> dict[str, tuple[int, tuple[int, str]]]:
        """By word, for those with words one edit away of which a half is held here: how many these are, and the one of largest
        count, as (-count, word). Words are distinct. A word both of whose halves are in place counts by its first half alone."""
        # The words that a segment is found in where its owners' lengths fit.
        met: dict[tuple[str, int, int, int], list[str]] = {}
        for word in words if self.owners else ():
            n = len(word)
            for end, (length, segment) in self.automaton.iter(word):
                for side in [0] * (end + 1 == length) + [1] * (end + 1 == n):
                    for other in (n - 1, n, n + 1):
                        if (side, other) in self.owners[segment]:
                            met.setdefault((segment, side, other, n), []).append(word)
        out: dict[str, tuple[int, tuple[int, str]]] = {}
        for (segment, side, other, _), own in met.items():
            held = self.owners[segment][side, other]
            for word, count, first in self._verified(own, held, side, other // 2):
                best = (-held[first][1], held[first][0])
                before = out.get(word)
                out[word] = (count, best) if before is None else (before[0] + count, min(before[1], best))
        return out

    def _verified(self, words: list[str], held: list[tuple[str, int]], side: int, half: int) -> Iterator[tuple[str, int, int]]:
        """(word, how many of held are near, the first of them) of words that have any."""
        if len(words) * len(held) <= self.FEW:
            for word in words:
                found = [k for k, (other, _) in enumerate(held) if one_edit(other, word) and not (side and word.startswith(other[:half]))]
                if found:
                    yield word, len(found), found[0]
            return
        mine, theirs = _codes(words), _codes([w for w, _ in held])
        step = max(1, self.CELLS // theirs.size)
        for k in range(0, len(words), step):
            some = mine[k : k + step]
            hit = _edits(some[:, half:], theirs[:, half:]) if not side else _edits(some[:, : some.shape[1] - theirs.shape[1] + half], theirs[:, :half])
            if side:
                hit &= ~(some[:, None, :half] == theirs[None, :, :half]).all(2)
            for row in np.flatnonzero(hit.any(1)).tolist():
                yield words[k + row], int(hit[row].sum()), int(hit[row].argmax())


def _sides(word: str) -> Column:
    """The halves of a word, as (side, segment)."""
    half = F.floor(F.length(word) / 2).cast("int")
    side = lambda s, segment: F.struct(F.lit(s).alias("side"), segment.alias("segment"))
    return F.array(side(0, F.substring(word, F.lit(1), half)), side(1, F.substring(word, half + 1, F.length(word))))


def _possible(word: str) -> Column:
    """Every half that a word one edit away may have left in this one, as (side, segment)."""
    n = F.length(word)
    side = lambda s, segment: F.struct(F.lit(s).alias("side"), segment.alias("segment"))
    out = []
    for d in (-1, 1):
        first = F.floor((n + d) / 2).cast("int")
        last = n + d - first
        out += [side(0, F.substring(word, F.lit(1), first)), side(1, F.substring(word, n - last + 1, last))]
    # Of a length as this one's, the first half is as long as in the shorter or the longer word, and so is the second.
    return F.array_distinct(F.array(*out))


def near_words(words: DataFrame, *, a_shard: int = 200_000, a_segment: int = 20_000) -> DataFrame:
    """(word, n_near, near, near_n) of every word of (word, n) that has words one edit away: how many, and which of them has the
    largest n (ties: the smallest in code-point order) with that n. Words must be distinct and have two code points at least.

    About a_shard rows meet in a task; a segment of more than a_segment words is dealt over several shards.
    """
    spark = words.sparkSession
    words = words.select("word", "n")
    shards = max(parts(spark), -(-6 * words.count() // a_shard))
    held = words.select("word", "n", F.inline(_sides("word")))
    scanned = words.select("word", F.inline(_possible("word")))
    common = held.groupBy("side", "segment").agg(F.ceil(F.count("*") / a_segment).cast("int").alias("k"))
    # What no automaton holds is not looked for.
    scanned = scanned.join(common, ["side", "segment"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    held = held.join(common, ["side", "segment"]).withColumn("salt", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    shard = F.pmod(F.xxhash64("side", "segment", "salt"), F.lit(shards)).cast("int").alias("shard")
    rows = held.select(shard, "side", "segment", "word", "n").unionByName(scanned.select(shard, F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("segment"), "word", F.lit(0).cast("bigint").alias("n")))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["side"].notna()
        found = Halves(pdf.loc[own, ["side", "segment", "word", "n"]].itertuples(index=False, name=None)).near(pdf.loc[~own, "word"].unique())
        return pd.DataFrame([(word, n, best, -count) for word, (n, (count, best)) in found.items()], columns=["word", "n_near", "near", "near_n"])

    # So many partitions, whatever their bytes: the work is in the comparisons.
    found = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(scan, "word string, n_near bigint, near string, near_n bigint")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", "b.near_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, which has none itself. A step doubles what has been
    followed, and is written. Forms must not run in circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        then = written(then.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(now)
        now = then.select("word", "root")
        now.scratch = then.scratch
        if not then.filter("moved").head(1):
            return now


def spelling_variants(words: DataFrame, *, times: int = 2, least_length: int = 5, a_shard: int = 200_000, a_segment: int = 20_000) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of (word, n), each word once.

    n_near counts the words one edit away. The form is the one of these with the largest n (ties: smallest in code-point
    order) if that is at least `times` n, else null; the root is where forms end, the word itself without a form. Rows with a
    null word, and words under least_length code points (2 at least), are left out; an empty table gives no rows; extra columns are
    ignored. Of repeated rows of a word the largest n counts.
    """
    if times < 2 or least_length < 2:
        raise ValueError("forms need twice the count, and halves two code points")
    words = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.max("n").cast("bigint").alias("n"))
    words = written(words, "words")
    out = words.join(near_words(words, a_shard=a_shard, a_segment=a_segment), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    out = written(out.select("word", "n", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")), "variants")
    roots = last_forms(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
