"""Small aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.controls import zero


def count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def total(column: str, name: str | None = None) -> Column:
    """Sum with nulls read as zero (still null when there are no rows)."""
    return F.sum(zero(column)).alias(name or column)


def raw_total(column: str, name: str | None = None) -> Column:
    """Plain sum: null when every value is null."""
    return F.sum(column).alias(name or column)


def sure_total(column: str | Column, name: str) -> Column:
    """Sum that is zero when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0)).alias(name)


def distinct_if(column: str, condition: Column, name: str) -> Column:
    return F.count_distinct(F.when(condition, F.col(column))).alias(name)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two digits, null when the whole is zero.

    Divided as decimals: a double would round some exact halves the wrong way.
    """
    n = "decimal(20,0)"
    share = (F.lit(100).cast("decimal(3,0)") * part.cast(n)) / F.nullif(whole.cast(n), F.lit(0).cast(n))
    return F.round(share, 2).cast("double")
