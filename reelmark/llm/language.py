"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own training text. A text is cut into pieces that
are compressed on their own, so a long text cannot become its own dictionary, and the language whose dictionary
gives the smallest total wins. The lead over the runner-up is the score; narrow leads may be rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, map_columns, without

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
UND = "und"


def letters(text: str) -> bytes:
    """Lower-cased, each run of anything but letters one space: marks and figures say nothing of the language."""
    return OTHER.sub(" ", text.lower()).encode()


def learn_dictionaries(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = 80, dictionary_bytes: int = 32_000) -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of training rows.

    The bound: per language the rows_each rows with the smallest hashes of their id, of any length; of these, evenly
    cut pieces up to dictionary_bytes. Only ids are ranked; of the texts of the chosen ids alone, the middle
    dictionary_bytes reach the driver. Rows that repeat an id with the same text are one piece, rows of one id with different
    texts one each; null ids are an id; null languages and null or empty texts teach nothing, and an empty table gives no
    dictionary. Languages come in order of their training rows, commonest first, equals by name. Only the three named
    columns and those of `train` are read, whatever others are called.
    """
    taught = docs.filter(train).select(column(id_col).alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"))
    taught = taught.filter("lang is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    rows = taught.select("id", "lang", "h")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    chosen = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= rows_each).select("id", "lang", "h").distinct()
    # At most rows_each rows of each language; repeats of them are dropped again before they reach the driver.
    texts = taught.join(F.broadcast(chosen), (taught["id"].eqNullSafe(chosen["id"])) & (taught["lang"] == chosen["lang"]) & (taught["h"] == chosen["h"]), "left_semi").dropDuplicates(["id", "lang", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, middles = [], []
            for text in batch.column(1).to_pylist():
                own = letters(text)
                # Of the same parity as the text, so that the middle of the middle is the text's.
                left = min(len(own), dictionary_bytes + (len(own) - dictionary_bytes) % 2)
                heads.append(text[:200])
                middles.append(own[(len(own) - left) // 2 :][:left])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string()), pa.array(middles, pa.binary())], names=["lang", "head", "middle"])

    by: dict[str, list[bytes]] = {}
    pieces = texts.select("lang", "text").mapInArrow(cut, "lang string, head string, middle binary")
    for lang, _, middle in sorted((r[0], r[1], bytes(r[2])) for r in pieces.collect()):
        by.setdefault(lang, []).append(middle)
    held = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row per language
    out = {}
    for lang, own in sorted(by.items(), key=lambda x: (-held.get(x[0], 0), x[0])):
        share = max(64, dictionary_bytes // len(own))
        out[lang] = b"\n".join(t if len(t) <= share else t[(len(t) - share) // 2 :][:share] for t in own)
    return out


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int, piece: int):
        self.langs, self.piece, self.all = list(dictionaries), piece, []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), source_size=piece, write_content_size=False, write_dict_id=False)
            self.all.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, lead): und and 0 without a letter; the lead is 1 - best / second best, 1 for one language."""
        if not text or not self.all or not LETTER.search(text):
            return UND, 0.0
        data = letters(text)
        # Pieces of equal length, so that none is too short to tell.
        n = max(1, round(len(data) / self.piece))
        cuts = [len(data) * k // n for k in range(n + 1)]
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes = np.array([sum(len(c(p)) for p in pieces) for c in self.all], float)
        best = int(np.argmin(sizes))  # ties: the commonest language, which comes first
        if len(sizes) == 1:
            return self.langs[0], 1.0
        return self.langs[best], float(1 - sizes[best] / np.partition(sizes, 1)[1])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", least_lead: float = 0.003, level: int = 7, piece_bytes: int = 1000) -> DataFrame:
    """Every column of docs, plus lang_pred, lang_score and lang_rejected.

    Null texts and texts without a letter are `und`, score 0, rejected. A lead under least_lead is rejected too;
    its best guess stays in lang_pred. Texts of equal size under two dictionaries (a tie) go to the first of them, with
    lead 0. Repeated rows are each judged, whatever their ids, which are not read. An empty table gives no rows. Input
    columns of the three added names, in any case, are replaced; all others stay, whatever their names.
    """
    names = ("lang_pred", "lang_score", "lang_rejected")
    docs = without(docs, *names)
    at = docs.columns.index(text_col)
    tables = docs.sparkSession.sparkContext.broadcast((dictionaries, level, piece_bytes))  # dictionary_bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(*tables.value)
        for batch in batches:
            got = [model.predict(t) for t in batch.column(at).to_pylist()]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            bad = [a == UND or b < least_lead for a, b in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], names=[*batch.schema.names, *names])

    return map_columns(docs, run, "lang_pred string, lang_score double, lang_rejected boolean")
