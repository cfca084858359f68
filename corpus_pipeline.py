"""From raw documents to packed training sequences: quality, lines, near duplicates, benchmarks, packing.

Every stage works on all documents the one before it kept and its decisions take effect: the next stage reads what it
wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm import quality
from tallyline.llm.decontaminate import without_matches
from tallyline.llm.line_dedup import without_repeated_lines
from tallyline.llm.near_dedup import near_duplicates
from tallyline.llm.packing import pack
from tallyline.llm.queries import GOOD_FROM, table, vocabulary
from tallyline.llm.shared import saved


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from the labelled ones outside the held-out fold."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")), GOOD_FROM)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each fuzzy line once; n_chars counts what is left. A document goes if others hold every line it had."""
    out = without_repeated_lines(docs)
    emptied = (F.col("n_kept") < F.col("n_lines")) & ~F.coalesce(F.col("text").rlike(r"[^\x09-\x0D ]"), F.lit(False))
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """One row of those that share an id and a text, with a number ``_row`` in the order of ids; all rows without an id."""
    marked = docs.withColumn("_text", F.xxhash64("text"))
    numbers = marked.where("doc_id is not null").select("doc_id", "_text").distinct().orderBy("doc_id", "_text")
    numbers = saved(numbers.withColumn("_row", F.monotonically_increasing_id()), "numbers")
    found = marked.join(numbers, ["doc_id", "_text"], "left").drop("_text")
    first = F.row_number().over(Window.partitionBy("_row").orderBy(*docs.columns))
    single = found.where("_row is not null").withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return saved(single.unionByName(found.where("_row is null")), "rows")


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8. Empty texts are no copies.

    Rows that share an id are judged each by its text; those that share both are one document.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    rows, key = (docs, "doc_id") if repeated.isEmpty() else (numbered_rows(docs), "_row")
    gone = near_duplicates(rows, id_col=key, size=5, percent=80).where("not kept").select(key)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row from the benchmark."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary(), capacity=2048, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("line_dedup", unique_lines),
    ("near_dedup", unique_documents),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

# Models and tokens have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
