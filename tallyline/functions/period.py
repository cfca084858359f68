"""Reporting periods. The date a period is taken from is always an argument."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """A closed range of calendar days."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"period ends {self.end} before it starts {self.start}")

    @property
    def after(self) -> date:
        """First day past the period."""
        return self.end + DAY

    def holds(self, ts: str | Column) -> Column:
        """True for timestamps inside the period.

        Compares the bare column with date literals, so the test reaches the
        Parquet scan for both timestamp types.
        """
        c = F.col(ts) if isinstance(ts, str) else ts
        return (c >= F.lit(self.start)) & (c < F.lit(self.after))

    def holds_run_date(self, run_date: str = "run_date") -> Column:
        """True for integer yyyymmdd keys inside the period."""
        return F.col(run_date).between(as_run_date(self.start), as_run_date(self.end))


def as_run_date(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def previous_week(as_of: date) -> Period:
    """The last full Monday-to-Sunday week before the week of ``as_of``."""
    monday = as_of - timedelta(days=as_of.weekday())
    return Period(monday - timedelta(days=7), monday - DAY)


def previous_month(as_of: date) -> Period:
    last = as_of.replace(day=1) - DAY
    return Period(last.replace(day=1), last)


def previous_week_of(day: Column) -> tuple[Column, Column]:
    """First and last day of the full week before each value's week."""
    monday = F.to_date(F.date_trunc("week", day))
    return F.date_sub(monday, 7), F.date_sub(monday, 1)


def previous_month_of(day: Column) -> tuple[Column, Column]:
    first = F.trunc(day, "month")
    return F.to_date(F.add_months(first, -1)), F.date_sub(first, 1)


def narrow(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to each argument; an argument of None does not filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df
