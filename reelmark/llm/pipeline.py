"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir), docs being what the one before kept, and returns a DataFrame. All but the last return
the columns of docs, whatever further ones there are and whatever their names. An empty table goes through every stage.
Very long texts are taken whole by all of them, one at a time in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, held_out, kept_alone, table
from .decontaminate import find_items
from .language import identify, learn_dictionaries
from .line_dedup import dedup_lines
from .near_duplicates import near_duplicate_components
from .packing import pack_documents
from .queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null and empty texts, no letter, or a narrow lead; a tie of the
    two best is no lead. Repeated rows are each judged by their text alone, so they go or stay together."""
    found = identify(docs, learn_dictionaries(docs, ~held_out("doc_id", 4, 2)))
    return found.filter(~F.col("lang_rejected")).select(*map(column, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller id has, and documents of which nothing but white space is left.
    n_chars follows the text. Rows of one id, repeated ones too, are one document; rows with a null id keep all lines.
    Null and empty texts lose nothing and stay, null ones as ''."""
    kept = dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.length("text").cast("bigint")
    return kept.withColumns({c: size for c in docs.columns if c == "n_chars"}).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays, with all its rows; of copies that is so
    too. Rows without an id stay, and so do null, empty and wordless texts, which are like no other."""
    gone = near_duplicate_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*map(column, docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item. Null and empty texts hold none; ids are not read, so
    repeated rows go or stay together. Without benchmark items all stay."""
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_words") == 0).select(*map(column, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of the documents into sequences of 2048; every row is packed, repeated ones each. Null and
    empty texts are one piece of the end id."""
    return pack_documents(docs, tokenizer_path(), size=2048, end_id=0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: Tokenizers, compressors and trained dictionaries have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token pieces of the documents that every stage kept, with their place in the packed sequences. A stage's
    intermediate tables, and the rows it read, are deleted once its own are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = kept_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
