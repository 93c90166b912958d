"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A window of `width` item words is a pattern; items with fewer words are one shorter pattern. Words become numbers of a
vocabulary of the items. Patterns of one length share tables: the shift table, a byte per hash of a block of up to three
words, holds the least distance of such a block from a pattern's end, and lets the search skip length - block + 1 words at
blocks of no pattern; a block with shift zero selects, by the hash of the suffix, the bucket of patterns ending in it, and
direct comparison confirms. Patterns are places in the items' words, so a table takes some 40 bytes a word.

The item table is cut into blocks of bounded size. Tasks make their tables and write them to the shared folder; tasks that
search read them one after another for the texts they hold, so documents are read once and neither shuffled nor rewritten.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_columns, shared_dir, without

#: A-Z to a-z; everything that is neither letter, digit nor beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


STEP, LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Search for word patterns of one length: the `length` words of `words` from each of `starts` on, an owner each."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owners: list, block: int = 3):
        self.length, self.block, self.words = length, min(block, length), words
        # Equal patterns are one, with all their owners: `firsts` are their places, `whose` their owners.
        rows = np.lib.stride_tricks.sliding_window_view(words, length)[starts]
        order = np.lexsort(rows.T[::-1])
        new = np.ones(len(order), bool)
        for at in range(1, len(order), 1 << 18):
            part = rows[order[at - 1 : at + (1 << 18)]]
            new[at : at + len(part) - 1] = (part[1:] != part[:-1]).any(axis=1)
        cuts = np.flatnonzero(new)
        firsts = starts[order[cuts]]
        whose = [frozenset(owners[k] for k in order[a:b].tolist()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
        # Hashes of all blocks, by the place of their last word.
        self.bits = max(10, int(4 * len(firsts) * (length - self.block + 1)).bit_length())
        self.shift = bytearray(b"%c" % min(255, length - self.block + 1)) * (1 << self.bits)
        table = np.frombuffer(self.shift, np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(table, self._hashes(firsts + end - self.block), min(255, length - end))
        suffix = self._hashes(firsts + length - self.block)
        order = np.argsort(suffix, kind="stable")
        self.suffixes, self.firsts, self.whose = suffix[order], firsts[order], [whose[k] for k in order.tolist()]

    def _hashes(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the blocks of pattern words that begin at places."""
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h = (h + self.words[at + k].astype(np.uint64)) * np.uint64(STEP)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: list[int]) -> Iterator[tuple[int, frozenset]]:
        """(start, owners) of every place of the numbered words where a pattern stands. The number 0 is in no pattern."""
        b, length, shift, down = self.block, self.length, self.shift, 64 - self.bits
        default, n, end = length - b + 1, len(words), length
        while end <= n:
            h = 0
            for k in range(end - b, end):
                w = words[k]
                if not w:
                    break
                h = (h + w) * STEP & LOW
            else:
                skip = shift[h >> down]
                if skip:
                    end += skip
                    continue
                at, own = end - length, words[end - length : end]
                first = int(np.searchsorted(self.suffixes, h >> down))
                while first < len(self.suffixes) and self.suffixes[first] == h >> down:
                    if self.words[self.firsts[first] : self.firsts[first] + length].tolist() == own:
                        yield at, self.whose[first]
                        break
                    first += 1
                end += 1
                continue
            # No pattern reaches over a word that is in no item.
            end = k + 1 + length if k + 1 - b >= end - b else end + default


class Matchers:
    """The vocabulary of some items and a table per pattern length, for (item id, text) rows; a null or wordless text has
    no pattern."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        words, starts, owners, at = [], {}, {}, 0
        for item, text in items:
            own = words_of(text or b"")
            size = min(width, len(own))
            if not size:
                continue
            words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int32))
            n = len(own) - size + 1
            starts.setdefault(size, []).append(np.arange(at, at + n))
            owners.setdefault(size, []).extend([item] * n)
            at += len(own)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.tables = [WuManber(size, flat, np.concatenate(s), owners[size]) for size, s in starts.items()]

    def search(self, words: list[bytes]) -> tuple[set[int], set]:
        """(places hit, owners) in a document's words."""
        hit, found = set(), set()
        if self.tables:
            own = [self.vocabulary.get(w, 0) for w in words]
            for m in self.tables:
                for at, owners in m.search(own):
                    hit.update(range(at, at + m.length))
                    found |= owners
        return hit, found


def find_items(docs: DataFrame, items: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, held_bytes: int = 32 << 20) -> DataFrame:
    """Every column of docs, plus n_words, hit_words (places, sorted) and items (ids as strings, sorted).

    Null and empty texts have no words; an item with a null id is looked for under the id "null", one without words hits
    nothing, and repeated items are one. Repeated rows are each searched, whatever their ids, which are not read. An empty
    table gives no rows, an empty item table no hits. Input columns of the added names, in any case, are replaced; all others
    stay, whatever their names. A text is searched whole, however long, in one task.

    Items are dealt into blocks of about block_bytes of text, whose tables tasks make and write to the shared folder; an item is
    in one block, so a single longer one makes a block of its size. There is one pass over the documents, whatever the number of
    blocks: a task holds about held_bytes of texts (one at least) and one block's tables at a time.
    """
    docs = without(docs, "n_words", "hit_words", "items")
    keyed = items.select(F.coalesce(column(item_col).cast("string"), F.lit("null")).alias("item"), column(item_text_col).cast("binary").alias("text"))
    size = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    folder = shared_dir(docs.sparkSession, "tables")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        at, root = FileSystem.from_uri(folder)
        at.create_dir(root, recursive=True)
        block, attempt = int(pdf["block"].iloc[0]), f"{root}/.{uuid.uuid4().hex}"
        with at.open_output_stream(attempt, compression=None) as f:
            f.write(pickle.dumps(Matchers(list(zip(pdf["item"], pdf["text"], strict=True)), width), protocol=5))
        at.move(attempt, f"{root}/{block}")
        return pd.DataFrame({"block": [block]})

    made = keyed.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(build, "block int")
    return _search(docs, folder, sorted(r["block"] for r in made.collect()), text_col, held_bytes)


#: The tables that this worker has read last, by folder and block.
_TABLES: dict[tuple[str, int], Matchers] = {}


def _tables(folder: str, block: int) -> Matchers:
    if (folder, block) not in _TABLES:
        _TABLES.clear()
        at, root = FileSystem.from_uri(folder)
        with at.open_input_file(f"{root}/{block}") as f:
            _TABLES[folder, block] = pickle.loads(f.read())
    return _TABLES[folder, block]


def _search(docs: DataFrame, folder: str, blocks: list[int], text_col: str, held_bytes: int) -> DataFrame:
    """A pass over the documents with every block's tables."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = blocks
        for part in _parts(batches, at, held_bytes):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            n_words, hits, items = [len(words_of(t or b"")) for t in texts] if not order else [0] * len(texts), [set() for _ in texts], [set() for _ in texts]
            for block in order:
                search = _tables(folder, block).search
                for k, text in enumerate(texts):
                    words = words_of(text or b"")
                    hit, owners = search(words)
                    n_words[k] = len(words)
                    hits[k] |= hit
                    items[k] |= owners
            order = order[::-1]  # the tables at hand come first
            new = [pa.array(n_words, pa.int64()), pa.array(map(sorted, hits), pa.list_(pa.int32())), pa.array(map(sorted, items), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "n_words", "hit_words", "items"])

    return map_columns(docs, run, "n_words bigint, hit_words array<int>, items array<string>")


def _parts(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches whose texts have about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
        bounds = np.flatnonzero(np.diff((size + np.cumsum(sizes)) // most, prepend=size // most)).tolist()
        begin = 0
        for end in bounds:
            held.append(batch.slice(begin, end + 1 - begin))
            yield pa.concat_batches(held)
            held, begin = [], end + 1
        held.append(batch.slice(begin))
        size += int(sizes.sum())
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)
