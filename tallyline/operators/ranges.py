"""Joining facts to the time windows they fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days are grouped by 32, those groups by 32 again, and so on; five levels cover 90,000 years.
BITS, LEVELS = 5, 5


def _run(first: Column, last: Column, level: int) -> Column:
    """The cells from first to last of a level; none if they are in the wrong order."""
    cells = F.transform(F.sequence(first, last), lambda c: F.struct(F.lit(level).alias("_level"), c.alias("_cell")))
    return F.when(first <= last, cells).otherwise(F.array().cast("array<struct<_level: int, _cell: int>>"))


def interval_cover(first: Column, last: Column) -> Column:
    """The fewest aligned intervals of 32**level days that together are the days from first to last.

    At most 62 of a level: what does not fill an interval of the next level at either end.
    """
    out = []
    for level in range(LEVELS - 1):
        inner_first, inner_last = F.shiftright(first + ((1 << BITS) - 1), BITS), F.shiftright(last + 1, BITS) - 1
        head = _run(first, F.shiftleft(inner_first, BITS) - 1, level)
        tail = _run(F.shiftleft(inner_last + 1, BITS), last, level)
        out.append(F.when(inner_first <= inner_last, F.concat(head, tail)).otherwise(_run(first, last, level)))
        first, last = inner_first, inner_last
    return F.concat(*out, _run(first, last, LEVELS - 1))


def join_windows(
    facts: DataFrame, windows: DataFrame, keys: tuple[str, ...], ts: str, start: str, end: str
) -> DataFrame:
    """Inner join of facts to windows with equal keys and start <= ts <= end.

    Spark has no range index: on the keys alone, all facts of a key meet all its windows. So a window becomes the few
    aligned intervals that make it up (``interval_cover``; an open end such as the year 9999 costs some hundred), a fact
    the intervals its day lies in, one for each level that some window uses. (level, cell) joins the equality keys, and the exact
    bounds finish the test. The intervals of a window do not overlap, so no pair appears twice. The windows side goes through
    Spark's own size-checked broadcast; past that size the shuffle is spread over (keys, level, cell), with skewed cells split at run time.
    """
    first, last = F.unix_date(F.to_date(start)), F.unix_date(F.to_date(end))
    spread = windows.filter(F.col(start) <= F.col(end)).select("*", F.inline(interval_cover(first, last)))
    top = spread.agg(F.coalesce(F.max("_level"), F.lit(0)).alias("top")).scalar()
    day = F.unix_date(F.to_date(ts))
    by_level = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright(day, BITS * n).alias("_cell")) for n in range(LEVELS)])
    dated = facts.select("*", F.inline(F.slice(by_level, F.lit(1), top + 1)))
    return (
        dated.join(spread, [*keys, "_level", "_cell"])
        .filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end)))
        .drop("_level", "_cell")
    )
