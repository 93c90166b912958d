"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most `size` ids. A plan needs only how many pieces there are of each
length, at most `size` numbers, which the driver holds whatever the input. It takes lengths from the longest,
looks up singles, pairs and triples whose sum is exactly the gap, and consumes as many copies of a combination
as all its lengths are available; lengths without such a combination are filled best-fit. Each step uses up at
least one length or halves it, so the plan has a bounded number of steps and is shipped to the tasks, where a
piece finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, parts, written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: A Latin word (A-Z and the letters of U+00C0 to U+00FF) and the marks around it: a run of marks is one token part. The
#: apostrophe, which begins contractions, is none.
MARKS = string.punctuation.replace("'", "")
LATIN = rf"^(?P<head>[{re.escape(MARKS)}]*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[{re.escape(MARKS)}]*)$"
_WORKER: dict = {}


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of the pool that begin at start, one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordCache:
    """Token ids of texts, by the chunk between spaces.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its chunks in
    order. Letters and the marks around them are tokens apart, so Latin words are taken out of their marks: Arrow splits,
    lower-cases and makes them distinct, and the tokenizer gets them many to a text, where each ends at an id whose piece is a
    word's end. Chunks of other kinds are encoded one by one; a worker keeps about `entries` of those.
    """

    def __init__(self, path: str, entries: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # Special pieces are ids of their own wherever they stand, also in a word.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.entries, self.known, self.marks = entries, {"": b""}, {"": b""}

    def _each(self, some: list[str], into: dict[str, bytes]) -> None:
        for k in range(0, len(some), 20_000):
            part = some[k : k + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                into[w] = np.array(e.ids, np.uint32).tobytes()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of lower-case letters, one after another, and how many each has; 4000 words to a text."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 4000):
            some = words[k : k + 4000]
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) != len(some):  # a letter that the tokenizer splits at
                each: dict[str, bytes] = {}
                self._each(some, each)
                own, ends = np.frombuffer(b"".join(map(each.__getitem__, some)), np.uint32), np.cumsum([len(each[w]) // 4 for w in some])
            ids.append(own)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _looked_up(self, texts: list[str], held: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, one after another, and how many each has; what is not held is learned."""
        self._each(list(set(texts).difference(held)), held)
        found = list(map(held.__getitem__, texts))
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned 32-bit ids of all texts, one after another, and where each text begins (and the last ends)."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        taken = pc.extract_regex(distinct, LATIN)
        latin = pc.is_valid(taken)
        for s in self.special:
            latin = pc.and_not(latin, pc.match_substring(distinct, s, ignore_case=True))
        latin = latin.to_numpy(zero_copy_only=False)
        # Three stretches a chunk, in one pool of ids: the marks before, the word, the marks behind. Other chunks are words.
        start, size = np.zeros((len(distinct), 3), np.int64), np.zeros((len(distinct), 3), np.int64)
        pools, held = [], 0

        def lay(rows: np.ndarray, part: int, which: np.ndarray, pool: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal held
            start[rows, part], size[rows, part] = (held + np.cumsum(sizes) - sizes)[which], sizes[which]
            pools.append(pool)
            held += len(pool)

        rows = np.flatnonzero(latin)
        own = taken.filter(pa.array(latin))
        words = pc.utf8_lower(pc.struct_field(own, "word")).dictionary_encode()
        lay(rows, 1, words.indices.to_numpy(), *self._words(words.dictionary.to_pylist()))
        for part, name in ((0, "head"), (2, "tail")):
            marks = pc.struct_field(own, name).dictionary_encode()
            lay(rows, part, marks.indices.to_numpy(), *self._looked_up(marks.dictionary.to_pylist(), self.marks))
        if max(len(self.known), len(self.marks)) > self.entries:
            self.known, self.marks = {"": b""}, {"": b""}
        rows = np.flatnonzero(~latin)
        lay(rows, 1, np.arange(len(rows)), *self._looked_up(distinct.filter(pa.array(~latin)).to_pylist(), self.known))
        each = size.sum(1)
        flat = _gather(np.concatenate(pools), start.ravel(), size.ravel())
        first, each_there = np.cumsum(each) - each, each[which]
        return _gather(flat, first[which], each_there), np.concatenate([[0], np.cumsum(each_there)])[chunks.offsets.to_numpy()]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, slice_bytes: int) -> Iterator[Iterator[tuple[int | None, np.ndarray]]]:
    """Of batches (id, text), slice by slice, each id and its text's unsigned 32-bit token ids with end_id behind them."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if _WORKER.get("path") != tokenizer_path:
        _WORKER.update(path=tokenizer_path, cache=WordCache(tokenizer_path))
    cache, end = _WORKER["cache"], np.array([end_id], np.uint32)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
        for a, b in _slices(texts, slice_bytes):
            flat, bounds = cache.encode(texts[a:b])
            yield ((i, np.append(flat[x:y], end)) for i, x, y in zip(ids[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def token_pieces(docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """The pieces of each document: its ids and then end_id, cut every `size` ids. Null texts are empty: one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in encoded(batches, tokenizer_path, end_id, slice_bytes):
            out: list[tuple] = []
            for i, tokens in texts:
                own = tokens.tobytes()
                for piece, at in enumerate(range(0, len(own), 4 * size)):
                    part = own[at : at + 4 * size]
                    out.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).mapInArrow(cut, PIECES)


class Sums:
    """Which singles, pairs and triples of the lengths at hand have a given sum.

    A hash table each for pairs and triples: under a sum, the candidates that name a combination, made when the sum is
    first asked for. Counts only fall, so a candidate found used up is taken out for good.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _left(self, x: int, used: tuple[int, ...]) -> bool:
        return self.have[x] > used.count(x)

    def single(self, gap: int, used: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self._left(gap, used) else None

    def pair(self, gap: int, used: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """(longer, shorter) with the smallest shorter one."""
        have = self.have
        if gap not in self.pairs:
            low = np.arange(1, max(gap, 0) // 2 + 1)
            self.pairs[gap] = low[(have[low] > 0) & (have[gap - low] > 0)][::-1].tolist()
        shorts = self.pairs[gap]
        while shorts and not (have[shorts[-1]] and have[gap - shorts[-1]]):
            shorts.pop()
        return next(((gap - x, x) for x in reversed(shorts) if self._left(x, used) and self._left(gap - x, (*used, x))), None)

    def triple(self, gap: int, used: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The longest length that a pair completes, and that pair."""
        if gap not in self.triples:
            self.triples[gap] = np.flatnonzero(self.have[: max(gap - 1, 0)]).tolist()
        firsts, k = self.triples[gap], len(self.triples[gap]) - 1
        while k >= 0:
            x = firsts[k]
            two = self.pair(gap - x, (*used, x)) if self._left(x, used) else None
            if two:
                return (x, *two)
            if not self.have[x] or not self.pairs.get(gap - x, [0]):
                del firsts[k]
            k -= 1
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Steps (number of sequences, [(length, copies in each)]) that place every piece.

    Combinations of one to four pieces that fill a sequence exactly come first, from the longest length down;
    what is left is filled best-fit: the longest piece, then again and again the longest that still fits.
    """
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    steps: list[tuple[int, list[tuple[int, int]]]] = []

    def take(lengths: list[int]) -> int:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(have[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                have[x] -= times * k
            steps.append((times, list(need.items())))
        return times

    sums = Sums(have)
    if have[size]:
        take([size])
    for fill in (sums.single, sums.pair, sums.triple):
        for length in np.flatnonzero(have)[::-1].tolist():
            while have[length] and (rest := fill(size - length, (length,))):
                take([length, *rest])
    while have.any():
        chosen, gap = [], size
        while gap > 0 and len(fit := np.flatnonzero(have[: gap + 1])):
            best = int(fit[-1])
            k = min(int(have[best]), gap // best)
            chosen += [best] * k
            gap -= k * best
            have[best] -= k
        for x in chosen:
            have[x] += 1
        take(chosen)
    return steps


def _slots(steps: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, copies in each, offset of the first copy), by rank."""
    out: dict[int, list[tuple]] = {}
    ranks, sequence = dict.fromkeys(range(size + 1), 0), 0
    for times, members in steps:
        offset = 0
        for length, k in members:
            out.setdefault(length, []).append((ranks[length], sequence, k, offset))
            ranks[length] += times * k
            offset += length * k
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(pieces: DataFrame, *, size: int = 2048, rows_a_task: int = 1_000_000) -> DataFrame:
    """Adds sequence_id (from 0) and offset to pieces with a `length` of 1 to `size`.

    A piece's rank among those of its length comes from its rank within a bucket of documents and the counts of
    the buckets before, so no length, however common, is numbered in one task.
    """
    spark = pieces.sparkSession
    counted = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = _slots(plan(counted, size), size)
    n = max(parts(spark), -(-sum(counted.values()) // rows_a_task))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    inside = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_bucket", "length").count().select("_bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1).join(first, ["_bucket", "length"]).withColumn("_rank", F.col("_first") + F.col("_rn"))
    ranked = ranked.select(*pieces.columns, "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            for length in np.unique(lengths).tolist():
                own, at = np.flatnonzero(lengths == length), slots[length]
                row = at[np.searchsorted(at[:, 0], ranks[own], "right") - 1]
                k = ranks[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * length
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes whole documents once and packs the pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are one piece that holds end_id alone. Rows with a null id are packed under it, and repeated rows
    give their pieces each; which of several equal pieces (a tie) takes which place is open, but every place is taken
    once. An empty table gives no rows. Extra columns, of whatever name, are ignored. Special pieces of the tokenizer that
    stand in a text are the ids that the tokenizer gives them. A very long text is tokenized whole, in one task.
    """
    return pack(written(token_pieces(docs, tokenizer_path, size=size, end_id=end_id, id_col=id_col, text_col=text_col), "pieces"), size=size)
