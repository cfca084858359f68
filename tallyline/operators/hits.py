"""Rule hits, exclusions and the reporting cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.aggregates import count_if, percent
from tallyline.functions.hits import AGE_BANDS, age_band, age_days, cohort, excluded, open_at, reported_by, required
from tallyline.functions.period import Period, narrow
from tallyline.operators.kpi import GROUP

HIT_COLUMNS = (
    "rpt_grp_id", "rpt_grp_name", "rule_id", "attempt_id", "external_txn_key", "galactic_id", "mtcn",
    "activity_type", "exclusion_reason_id", "is_reported", "batch_id", "efile_batch_id", "reported_batch_id",
    "transaction_date", "reporting_timestamp", "source", "transaction_side",
)
AUDIT_COLUMNS = (
    "attempt_id", "rpt_grp_id", "rpt_grp_name", "rule_id", "bucket_id", "external_txn_key", "mtcn",
    "processing_batch_id", "exclusion_reason_id", "exclusion_strategy", "reported_batch_id",
    "reporting_timestamp", "created_timestamp", "modified_timestamp",
)


def _of_transaction(df: DataFrame, mtcn: str | None, external_txn_key: str | None) -> DataFrame:
    """Rows of a transaction by either of its keys; the numeric key is compared as text."""
    tests = []
    if mtcn is not None:
        tests.append(F.col("mtcn") == mtcn)
    if external_txn_key is not None:
        tests.append(F.col("external_txn_key").cast("string") == external_txn_key)
    return df.filter(tests[0] | tests[-1]) if tests else df


def rule_hit_detail(
    hits: DataFrame, rpt_grp_id: int | None = None, mtcn: str | None = None, external_txn_key: str | None = None
) -> DataFrame:
    return _of_transaction(narrow(hits, rpt_grp_id=rpt_grp_id), mtcn, external_txn_key).select(*HIT_COLUMNS)


def exclusion_audit_detail(
    audit: DataFrame, rpt_grp_id: int | None = None, mtcn: str | None = None, external_txn_key: str | None = None
) -> DataFrame:
    rows = _of_transaction(narrow(audit, rpt_grp_id=rpt_grp_id), mtcn, external_txn_key)
    return rows.select(*AUDIT_COLUMNS).orderBy(F.desc_nulls_last("modified_timestamp"), "rpt_grp_id", "attempt_id", "rule_id")


def rule_breakdown(hits: DataFrame, rpt_grp_id: int | None = None, batch_id: str | None = None) -> DataFrame:
    """Per group, batch and rule: hits, excluded, reported and not reported.

    Batches are found through efile_batch_id; rule_hit.batch_id is another numbering.
    """
    scoped = narrow(hits, rpt_grp_id=rpt_grp_id, efile_batch_id=batch_id).filter("efile_batch_id IS NOT NULL")
    return (
        scoped.groupBy("rpt_grp_id", F.col("efile_batch_id").alias("batch_id"), "rule_id")
        .agg(
            F.count("*").alias("rule_hits"),
            count_if(excluded(), "excluded"),
            count_if(F.col("is_reported"), "reported"),
            count_if(~F.col("is_reported"), "not_reported"),
        )
        .orderBy(F.desc("not_reported"), F.desc("rule_hits"))
    )


def with_share(counts: DataFrame, count: str, name: str) -> DataFrame:
    """Add each row's share of the grand total; the input is already one row per value."""
    everything = F.sum(count).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn(name, percent(F.col(count), everything))


def exclusion_reasons(hits: DataFrame, p: Period) -> DataFrame:
    counts = (
        hits.filter(p.holds("transaction_date") & excluded())
        .groupBy("exclusion_reason_id")
        .agg(F.count("*").alias("excluded_hits"))
    )
    return with_share(counts, "excluded_hits", "pct_of_excluded").orderBy(F.desc("excluded_hits"))


def exclusion_audit_summary(audit: DataFrame, p: Period) -> DataFrame:
    return (
        audit.filter(p.holds("created_timestamp"))
        .groupBy("exclusion_reason_id", "exclusion_strategy")
        .agg(F.count("*").alias("excluded_count"))
        .orderBy(F.desc("excluded_count"))
    )


def is_reported_distribution(hits: DataFrame) -> DataFrame:
    return hits.groupBy("is_reported").agg(F.count("*").alias("hit_count")).orderBy(F.asc_nulls_last("is_reported"))


def is_reported_vs_exclusion(hits: DataFrame) -> DataFrame:
    state = F.when(excluded(), "EXCLUDED").otherwise("NO_EXCLUSION").alias("exclusion_status")
    return (
        hits.groupBy("is_reported", state)
        .agg(
            F.count("*").alias("total_rows"),
            count_if(F.col("reporting_timestamp").isNull(), "reporting_timestamp_null"),
            count_if(F.col("reporting_timestamp").isNotNull(), "reporting_timestamp_present"),
            count_if(F.col("reported_batch_id").isNull(), "reported_batch_null"),
            count_if(F.col("reported_batch_id").isNotNull(), "reported_batch_present"),
        )
        .orderBy(F.asc_nulls_last("is_reported"), "exclusion_status")
    )


def cohort_balance(hits: DataFrame, p: Period) -> DataFrame:
    names = ("total_hits", "excluded", "requires_reporting", "reported", "open")
    m = hits.filter(p.holds("transaction_date")).agg(*cohort(p, names))
    t, e, r, d, o = (F.col(n) for n in names)
    return m.withColumns({"rule_hit_balance_diff": t - (e + r), "reporting_balance_diff": r - (d + o)})


def weekly_reporting_health(hits: DataFrame, p: Period) -> DataFrame:
    names = ("total_rule_hits", "excluded_hits", "requires_reporting", "reported_hits", "still_open")
    m = hits.filter(p.holds("transaction_date")).agg(*cohort(p, names))
    return m.withColumn("reported_pct", percent(F.col("reported_hits"), F.col("requires_reporting")))


def _backlog(hits: DataFrame, p: Period) -> DataFrame:
    """Hits of all history up to the period's end that are open then."""
    old = hits.filter(F.col("transaction_date") < F.lit(p.after)).filter(open_at(p))
    return old.withColumn("age", age_days(p.end))


def open_backlog_aging(hits: DataFrame, p: Period) -> DataFrame:
    age = F.col("age")
    bands = [
        count_if((age >= low) if high is None else age.between(low, high), f"open_{name}_days")
        for name, low, high in AGE_BANDS
    ]
    return _backlog(hits, p).agg(
        F.count("*").alias("total_open_backlog"), *bands, F.max("age").alias("oldest_open_days")
    )


def group_reporting_health(hits: DataFrame, p: Period) -> DataFrame:
    names = ("total_rule_hits", "excluded", "requires_reporting", "reported", "still_open")
    return hits.filter(p.holds("transaction_date")).groupBy(*GROUP).agg(*cohort(p, names)).orderBy(F.desc("still_open"))


def group_backlog_health(hits: DataFrame, p: Period) -> DataFrame:
    return (
        _backlog(hits, p)
        .groupBy(*GROUP)
        .agg(
            F.count("*").alias("still_open"),
            count_if(F.col("age") > 30, "open_over_30_days"),
            F.max("age").alias("oldest_open_days"),
        )
        .orderBy(F.desc("open_over_30_days"), F.desc("still_open"))
    )


def daily_reporting_trend(hits: DataFrame, p: Period) -> DataFrame:
    return (
        hits.filter(p.holds("transaction_date"))
        .groupBy(F.to_date("transaction_date").alias("day"))
        .agg(
            count_if(required(), "requires_reporting"),
            count_if(reported_by(p), "reported"),
            count_if(open_at(p), "open"),
        )
        .orderBy("day")
    )


def age_bands(hits: DataFrame, p: Period) -> DataFrame:
    """Open hits per age band in long form; a band without hits shows zero."""
    open_hits = _backlog(hits, p)
    counts = open_hits.agg(*[count_if(age_band(F.col("age")) == name, name) for name, _, _ in AGE_BANDS])
    return counts.unpivot([], [b[0] for b in AGE_BANDS], "age_band", "open_hits")


