"""Predicates on rule hits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.aggregates import count_if
from tallyline.functions.period import Period


def excluded() -> Column:
    return F.col("exclusion_reason_id").isNotNull()


def required() -> Column:
    return F.col("exclusion_reason_id").isNull()


def reported_by(p: Period) -> Column:
    """Needs reporting and was reported by the end of the period."""
    return required() & (F.col("reporting_timestamp") < F.lit(p.after))


def open_at(p: Period) -> Column:
    """Needs reporting and was not reported by the end of the period."""
    ts = F.col("reporting_timestamp")
    return required() & (ts.isNull() | (ts >= F.lit(p.after)))


def age_days(as_of: date) -> Column:
    return F.datediff(F.lit(as_of), F.to_date("transaction_date"))


# Age bands of open hits in days, both ends included.
AGE_BANDS = (("0_3", 0, 3), ("4_7", 4, 7), ("8_14", 8, 14), ("15_30", 15, 30), ("30_plus", 31, None))


def age_band(age: Column) -> Column:
    out = F
    for name, low, high in AGE_BANDS:
        inside = (age >= low) if high is None else age.between(low, high)
        out = out.when(inside, name)
    return out


def cohort(p: Period, names: tuple[str, str, str, str, str]) -> list[Column]:
    """Total, excluded, required, reported and open counts under the given names."""
    return [
        F.count("*").alias(names[0]),
        count_if(excluded(), names[1]),
        count_if(required(), names[2]),
        count_if(reported_by(p), names[3]),
        count_if(open_at(p), names[4]),
    ]
