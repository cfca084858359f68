"""Measures shown on the operations page: value, lag, funnel, breakdowns, drill and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.aggregates import count_if, percent
from tallyline.functions.hits import age_band, age_days, cohort, excluded, open_at, reported_by, required
from tallyline.functions.period import Period, narrow
from tallyline.operators.hits import with_share
from tallyline.operators.kpi import hit_totals
from tallyline.operators.snapshots import latest_recon

OPEN_HIT_COLUMNS = (
    "rpt_grp_id", "rpt_grp_name", "bucket_id", "rule_id", "attempt_id", "external_txn_key", "galactic_id", "mtcn",
    "source", "transaction_side", "transaction_date", "rule_currency_amount", "rule_iso_currency_code",
)
DRILL_ORDER = ("transaction_date", "external_txn_key", "rpt_grp_id", "rule_id", "attempt_id", "bucket_id")
# Fixed value: the exclusion reason that points to bad data rather than a decision.
DEFECT_REASON = "Invalid Data"


def _open(hits: DataFrame, p: Period) -> DataFrame:
    return hits.filter(F.col("transaction_date") < F.lit(p.after)).filter(open_at(p))


def open_value_by_currency(hits: DataFrame, p: Period, top: int = 3) -> DataFrame:
    """Open amount and hits of the ``top`` currencies and a mixed remainder.

    Amounts of different currencies are never added, so the remainder has hits only.
    """
    per = _open(hits, p).groupBy("rule_iso_currency_code").agg(
        F.count("*").alias("open_hits"),
        F.sum("rule_currency_amount").cast("decimal(38,2)").alias("open_amount"),
    )
    # One row per currency is left, so ranking them in one partition is small work.
    place = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc("open_hits"), F.asc_nulls_last("rule_iso_currency_code"))
    )
    named = F.col("place") <= top
    shown = F.when(named, F.coalesce(F.col("rule_iso_currency_code"), F.lit("unknown"))).otherwise("mixed")
    return (
        per.withColumn("place", place)
        .groupBy(shown.alias("currency"))
        .agg(F.sum("open_hits").alias("open_hits"), F.max(F.when(named, F.col("open_amount"))).alias("open_amount"))
    )


def hit_disposition(hits: DataFrame, p: Period) -> DataFrame:
    """Levels of the cohort with their share of all hits."""
    levels = {
        "1 total": F.lit(True),
        "2 excluded": excluded(),
        "3 requires reporting": required(),
        "4 reported": reported_by(p),
        "5 open": open_at(p),
        "6 open over 30 days": open_at(p) & (age_days(p.end) > 30),
    }
    wide = hits.filter(p.holds("transaction_date")).agg(*[count_if(c, n) for n, c in levels.items()])
    long = wide.withColumn("all_hits", F.col("1 total")).unpivot(["all_hits"], list(levels), "level", "hits")
    return long.select("level", "hits", percent(F.col("hits"), F.col("all_hits")).alias("pct_of_total"))


def report_lag(hits: DataFrame, p: Period) -> DataFrame:
    """Median and 95th percentile of days from transaction to report, per transaction day.

    Hits are first counted per (day, lag): lags are whole days, so the exact percentile
    works on a few counts however many hits a day has.
    """
    lag = F.datediff(F.to_date("reporting_timestamp"), F.to_date("transaction_date"))
    counts = (
        hits.filter(p.holds("transaction_date") & F.col("reporting_timestamp").isNotNull())
        .groupBy(F.to_date("transaction_date").alias("day"), lag.alias("lag"))
        .agg(F.count("*").alias("n"))
    )
    q = F.expr("percentile(lag, array(0.5, 0.95), n)")
    return counts.groupBy("day").agg(F.sum("n").alias("reported_hits"), q.alias("q")).select(
        "day", "reported_hits",
        F.round(F.col("q")[0].cast("double"), 6).alias("median_days"),
        F.round(F.col("q")[1].cast("double"), 6).alias("p95_days"),
    )


def exclusion_defects(hits: DataFrame, p: Period, defect: str = DEFECT_REASON) -> DataFrame:
    counts = (
        hits.filter(p.holds("transaction_date") & excluded())
        .groupBy("exclusion_reason_id")
        .agg(F.count("*").alias("excluded_hits"))
    )
    shares = with_share(counts, "excluded_hits", "pct_of_excluded")
    return shares.withColumn("is_defect", F.col("exclusion_reason_id") == defect)


def exclusion_daily_trend(hits: DataFrame, p: Period, reason: str) -> DataFrame:
    """Hits excluded for one reason per day; the peak day (the first, on a tie) is marked."""
    daily = (
        hits.filter(p.holds("transaction_date") & (F.col("exclusion_reason_id") == reason))
        .groupBy(F.to_date("transaction_date").alias("day"))
        .agg(F.count("*").alias("excluded_hits"))
    )
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("excluded_hits"), "day")
    return daily.withColumn("is_peak", F.row_number().over(order) == 1)


# A null group is a group of its own; only this column tells the total row.
def _is_total() -> Column:
    return (F.grouping("rpt_grp_id") == 1).alias("is_total")


def recon_table(hit_recon: DataFrame, p: Period) -> DataFrame:
    """Published, reported and missed hits per group and in total; ``is_total`` marks the total row."""
    published = F.sum(F.coalesce(F.col("rule_hit_publish_count_source"), F.lit(0))).alias("published")
    per = latest_recon(hit_recon, p).groupBy("rpt_grp_id").agg(published, *hit_totals())
    # The cube level runs over the per-group sums, not over the detail rows.
    names = ("published", "expected", "matched", "missed")
    return per.rollup("rpt_grp_id").agg(_is_total(), *[F.sum(n).alias(n) for n in names])


BREAKDOWN = ("total_rule_hits", "excluded", "requires_reporting", "reported", "still_open")


def group_breakdown(hits: DataFrame, p: Period) -> DataFrame:
    """Cohort counts per group with a total row, marked by ``is_total``; totals add up the groups."""
    per = hits.filter(p.holds("transaction_date")).groupBy("rpt_grp_id").agg(
        *cohort(p, BREAKDOWN), count_if(open_at(p) & (age_days(p.end) > 30), "open_over_30_days")
    )
    names = (*BREAKDOWN, "open_over_30_days")
    out = per.rollup("rpt_grp_id").agg(_is_total(), *[F.sum(n).alias(n) for n in names])
    return out.withColumn("reported_pct", percent(F.col("reported"), F.col("requires_reporting")))


def open_hits_drill(
    hits: DataFrame,
    p: Period,
    band: str | None = None,
    page_size: int | None = None,
    after: tuple | None = None,
    **filters,
) -> DataFrame:
    """Open hits, oldest first, by age band and optional exact filters.

    ``after`` holds the ``DRILL_ORDER`` values of the last row seen: pages continue by key
    instead of skipping rows. The order ends in the table's key, so no two rows tie.
    """
    rows = narrow(_open(hits, p), **filters).withColumn("age_days", age_days(p.end))
    rows = rows.withColumn("age_band", age_band(F.col("age_days")))
    if band is not None:
        rows = rows.filter(F.col("age_band") == band)
    order = DRILL_ORDER
    if after is not None:
        seen = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)]
        # The first test says nothing new, but it is one the scan can skip files by.
        rows = rows.filter((F.col(order[0]) >= seen[0]) & (F.struct(*order) > F.struct(*seen)))
    page = rows.select(*OPEN_HIT_COLUMNS, "age_days", "age_band").orderBy(*order)
    return page if page_size is None else page.limit(page_size)


def tie_out(hits: DataFrame, p: Period, published: DataFrame | None = None) -> DataFrame:
    """The identities the page must satisfy, each with both sides and whether they agree.

    The left sides are counted from the detail rows anew, without groups; the right sides are what the page shows:
    the total row and the sum of the group rows of ``published``, by default ``group_breakdown`` of the same hits.
    """
    names = (*BREAKDOWN, "open_over_30_days")
    shown = group_breakdown(hits, p) if published is None else published
    cohort_rows = hits.filter(p.holds("transaction_date"))
    counted = cohort_rows.agg(*cohort(p, BREAKDOWN), count_if(open_at(p) & (age_days(p.end) > 30), "open_over_30_days"))
    total = [F.coalesce(F.sum(F.when(F.col("is_total"), F.col(n))), F.lit(0)).alias(f"total {n}") for n in names]
    groups = [F.coalesce(F.sum(F.when(~F.col("is_total"), F.col(n))), F.lit(0)).alias(f"groups {n}") for n in names]
    right = shown.agg(*total, *groups).unpivot([], [f"{k} {n}" for k in ("total", "groups") for n in names], "check", "right_side")
    left = counted.unpivot([], list(names), "name", "left_side")
    parts = left.join(right, F.col("name") == F.element_at(F.split("check", " "), 2)).select("check", "left_side", "right_side")
    legs = counted.select(
        F.lit("excluded + reported + open = total").alias("check"),
        (F.col("excluded") + F.col("reported") + F.col("still_open")).alias("left_side"), F.col("total_rule_hits").alias("right_side"),
    )
    return parts.unionByName(legs).withColumn("passed", F.col("left_side").eqNullSafe(F.col("right_side")))
