"""Labelled rows to learn from: which rows may teach, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows no label may be learnt from: the CRC of the id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def teaching_ids(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", value: int | None = None) -> DataFrame:
    """At most ``bound`` ids with their label (the larger one of a repeated id), in the order of the ids' hashes.

    Held-out rows and rows without id or label are left out.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("label"))
    if value is not None:
        rows = rows.where(F.col("label") == value)
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(bound)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(label, text) of the given ids; they are at most as many as the documented bound, so they are broadcast."""
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(ids), id_col).select("label", "text")
