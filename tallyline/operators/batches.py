"""Batch-level totals, lists and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import controls as C
from tallyline.functions.aggregates import distinct_if, raw_total, total
from tallyline.functions.period import Period, narrow
from tallyline.operators.kpi import GROUP, with_batch_info
from tallyline.operators.snapshots import latest_batch
from tallyline.sources.tables import schema

REPORTABLE = ("expected_reportable_txn", "actual_reportable_txn")
ELIGIBLE = ("expected_activity_eligible_for_transformation", "actual_activity_eligible_for_transformation")
OUTCOME = ("activity_transformed", "activity_transformation_failed", "duplicate_transformation")


def problem_batches(recon: DataFrame, p: Period, k: int | None = None) -> DataFrame:
    """Batches with a broken control or failures, worst first; all of them unless ``k`` is given."""
    out = (
        latest_batch(recon, p)
        .filter(C.has_issue())
        .select(
            "batch_id", *GROUP, *REPORTABLE, C.gap("reportable").alias("reportable_diff"),
            *ELIGIBLE, C.gap("eligibility").alias("eligibility_diff"),
            "activity_transformation_failed", "duplicate_transformation", "modified_timestamp",
        )
        .orderBy(
            F.desc(F.abs("reportable_diff")), F.desc(C.zero("activity_transformation_failed")),
            F.desc_nulls_last("modified_timestamp"), *GROUP, "batch_id",
        )
    )
    return out if k is None else out.limit(k)


def report_group_batches(recon: DataFrame, p: Period, rpt_grp_id: int | None = None) -> DataFrame:
    """Batches of one group with their status (of every group when none is named)."""
    return (
        latest_batch(recon, p, rpt_grp_id)
        .select(
            "rpt_grp_id", "batch_id", "created_timestamp", "seq_no", "txn_selected", *REPORTABLE, *OUTCOME,
            *ELIGIBLE, C.health().alias("status"),
        )
        .orderBy(F.desc("created_timestamp"), "rpt_grp_id", "batch_id")
    )


def batch_control_summary(recon: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    """Both sides of each control of a batch; a difference is null when a side is."""
    return latest_batch(recon, None, rpt_grp_id, batch_id).select(
        "batch_id", *GROUP, "seq_no", "created_timestamp", "modified_timestamp", "txn_selected", "excluded_txn",
        "already_reported_count", *REPORTABLE, C.gap_or_null("reportable").alias("reportable_diff"),
        *ELIGIBLE, C.gap_or_null("eligibility").alias("eligibility_diff"), *OUTCOME, "soft_dedup_dropped_txn_count",
    )


def transformation_summary(recon: DataFrame, p: Period) -> DataFrame:
    return latest_batch(recon, p).agg(
        total("txn_selected", "selected_for_processing"),
        total("excluded_txn"),
        total("already_reported_count", "already_reported"),
        F.sum(C.zero("excluded_txn") + C.zero("already_reported_count")).alias("filtered_not_eligible"),
        total("txn_missing_attempt_count"),
        total("expected_reportable_txn", "expected_reportable"),
        total("actual_reportable_txn", "actual_reportable"),
        total("activity_transformed", "transformed"),
        total("activity_transformation_failed", "transformation_failed"),
        total("duplicate_transformation"),
        total("soft_dedup_dropped_txn_count", "soft_dedup_dropped"),
    )


def transformation_flow(recon: DataFrame, p: Period) -> DataFrame:
    """The same volumes without reading nulls as zero: an empty period gives nulls."""
    return latest_batch(recon, p).agg(
        raw_total("txn_selected", "selected_for_processing"),
        raw_total("excluded_txn"),
        raw_total("already_reported_count", "already_reported"),
        F.sum(C.zero("excluded_txn") + C.zero("already_reported_count")).alias("filtered_not_eligible"),
        raw_total("txn_missing_attempt_count", "join_errors"),
        raw_total("expected_reportable_txn", "expected_reportable"),
        raw_total("actual_reportable_txn", "actual_reportable"),
        raw_total("activity_transformed", "transformation_success"),
        raw_total("activity_transformation_failed", "transformation_failed"),
        raw_total("duplicate_transformation"),
        raw_total("soft_dedup_dropped_txn_count", "soft_dedup_dropped"),
    )


def reportable_recon(recon: DataFrame, p: Period) -> DataFrame:
    return latest_batch(recon, p).agg(
        total(REPORTABLE[0], "expected_reportable"),
        total(REPORTABLE[1], "actual_reportable"),
        F.sum(C.gap("reportable")).alias("reportable_difference"),
    )


def eligibility_recon(recon: DataFrame, p: Period) -> DataFrame:
    return latest_batch(recon, p).agg(
        total(ELIGIBLE[0], "expected_eligible"),
        total(ELIGIBLE[1], "actual_eligible"),
        F.sum(C.gap("eligibility")).alias("eligibility_difference"),
    )


def _three_gaps(raw: bool) -> tuple[Column, Column, Column]:
    if not raw:
        return C.gap("reportable"), C.gap("eligibility"), C.gap("transformation_with_dup")
    return (
        C.gap_or_null("reportable"),
        C.gap_or_null("eligibility"),
        C.gap_or_null("transformation_with_dup", null_parts_are_zero=True),
    )


def _out_of_balance(raw: bool) -> Column:
    a, b, c = _three_gaps(raw)
    return F.coalesce((a != 0) | (b != 0) | (c != 0), F.lit(False))


def recon_issue_counts(recon: DataFrame, p: Period, raw: bool = False) -> DataFrame:
    """Rows, groups and batches out of balance. With ``raw`` a control with a null side never counts."""
    bad = _out_of_balance(raw)
    return latest_batch(recon, p).agg(
        F.count_if(bad).alias("reconciliation_issues"),
        distinct_if("rpt_grp_id", bad, "affected_report_groups"),
        distinct_if("batch_id", bad, "affected_batches"),
    )


def recon_issue_detail(recon: DataFrame, p: Period, raw: bool = False) -> DataFrame:
    a, b, c = _three_gaps(raw)
    names = ("reportable_diff", "eligibility_diff", "transformation_diff")
    if not raw:
        names = ("reportable_diff", "activity_eligibility_diff", "transformation_disposition_diff")
    stamps = () if raw else ("created_timestamp", "modified_timestamp")
    return (
        latest_batch(recon, p)
        .filter(_out_of_balance(raw))
        .select(
            "batch_id", *GROUP, *REPORTABLE, a.alias(names[0]), *ELIGIBLE, b.alias(names[1]),
            *OUTCOME, c.alias(names[2]), *stamps,
        )
        .orderBy("rpt_grp_name", "batch_id", "rpt_grp_id")
    )


def batch_health_table(recon: DataFrame, p: Period) -> DataFrame:
    return (
        latest_batch(recon, p)
        .orderBy(C.health_rank(), F.desc_nulls_last("modified_timestamp"), "rpt_grp_id", "batch_id")
        .select(
            "batch_id", *GROUP, "seq_no", "txn_selected", *REPORTABLE, *ELIGIBLE, *OUTCOME,
            "txn_missing_attempt_count", C.gap("reportable").alias("reportable_diff"),
            C.gap("eligibility").alias("eligibility_diff"),
            C.health("NEEDS ATTENTION", "WARNING", "HEALTHY").alias("batch_status"),
            F.col("modified_timestamp").alias("last_updated"),
        )
    )


def batch_full_detail(recon: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Every snapshot of a batch with all its columns, newest first."""
    columns = [f.name for f in schema("report_transformation_reconciliation").fields]
    return (
        narrow(recon, batch_id=batch_id)
        .select(*columns)
        .orderBy(F.desc("seq_no"), F.desc_nulls_last("modified_timestamp"), "rpt_grp_id", "batch_id")
    )


def failures_by_batch(recon: DataFrame, p: Period) -> DataFrame:
    return (
        latest_batch(recon, p)
        .filter(C.has_failures())
        .select(*GROUP, "batch_id", F.col("activity_transformation_failed").alias("failed_count"), "modified_timestamp")
        .orderBy(F.desc("failed_count"), "rpt_grp_id", "batch_id")
    )


def control(recon: DataFrame, p: Period | None, name: str) -> DataFrame:
    """Both sides and the difference of one control, per batch."""
    whole = C.EQUATIONS[name][0]
    diff = C.gap(name)
    return latest_batch(recon, p).select(
        "rpt_grp_id", "batch_id", C.zero(whole).alias("left_side"), (C.zero(whole) - diff).alias("right_side"),
        diff.alias("difference"), (diff == 0).alias("balanced"),
    )


def processing_exceptions(recon: DataFrame, p: Period) -> DataFrame:
    """Missing attempts and failures. Their sum mixes two grains and stays for old reports only."""
    return latest_batch(recon, p).agg(
        total("txn_missing_attempt_count", "missing_attempts"),
        total("activity_transformation_failed", "transformation_failures"),
        F.sum(C.zero("txn_missing_attempt_count") + C.zero("activity_transformation_failed")).alias("processing_exceptions"),
    )


def exception_breakdown(recon: DataFrame, p: Period) -> DataFrame:
    a, b = "attempt_not_received", "transformation_failed"
    sums = latest_batch(recon, p).agg(
        raw_total("txn_missing_attempt_count", a), raw_total("activity_transformation_failed", b)
    )
    return sums.withColumn("total_processing_exceptions", F.col(a) + F.col(b))


def group_transformation_health(recon: DataFrame, p: Period) -> DataFrame:
    return (
        latest_batch(recon, p)
        .groupBy(*GROUP)
        .agg(
            raw_total("txn_selected"),
            raw_total("excluded_txn"),
            raw_total("already_reported_count", "already_reported"),
            raw_total("txn_missing_attempt_count", "join_errors"),
            raw_total("expected_reportable_txn", "expected_reportable"),
            raw_total("actual_reportable_txn", "actual_reportable"),
            raw_total("activity_transformed", "transformed"),
            raw_total("activity_transformation_failed", "transform_failed"),
            F.sum(C.gap_or_null("reportable")).alias("reportable_recon_diff"),
        )
        .orderBy(F.desc("transform_failed"), F.desc("join_errors"), *GROUP)
    )


def batch_health_weekly(recon: DataFrame, p: Period) -> DataFrame:
    diff = C.gap_or_null("reportable")
    return (
        latest_batch(recon, p)
        .select(
            "batch_id", *GROUP, F.col("txn_selected").alias("selected"),
            (C.zero("excluded_txn") + C.zero("already_reported_count")).alias("filtered_not_eligible"),
            F.col("txn_missing_attempt_count").alias("join_errors"),
            F.col("expected_reportable_txn").alias("eligible"), F.col("activity_transformed").alias("success"),
            F.col("activity_transformation_failed").alias("failed"),
            (C.zero("txn_missing_attempt_count") + C.zero("activity_transformation_failed")).alias("needs_attention"),
            diff.alias("reconciliation_diff"), F.col("modified_timestamp").alias("last_updated"),
        )
        .orderBy(
            F.desc("needs_attention"), F.desc_nulls_last(F.abs("reconciliation_diff")),
            F.desc_nulls_last("last_updated"), "rpt_grp_id", "batch_id",
        )
    )


# Sections of the control-room view and the columns behind them.
ROOM_CONTROLS = ("reportable", "lookback", "reporting_period", "activity", "transformation")


def batch_control_room(
    recon: DataFrame, batch_info: DataFrame, config: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None
) -> DataFrame:
    """Header, five controls with both sides and balance, and the other counters of a batch."""
    run = with_batch_info(latest_batch(recon, None, rpt_grp_id, batch_id), batch_info).join(
        config.select("rpt_grp_id", F.col("country_name").alias("country")), "rpt_grp_id", "left"
    )
    sides = []
    for name in ROOM_CONTROLS:
        whole, parts = C.EQUATIONS[name]
        diff = C.gap(name)
        sides += [
            C.zero(whole).alias(f"{name}_left"), (C.zero(whole) - diff).alias(f"{name}_right"),
            diff.alias(f"{name}_balance"),
        ]
    return run.select(
        *GROUP, "country", "batch_id", "seq_no", "process_timestamp", "batch_status", "compiler_status",
        "report_status", C.health_five_level().alias("health"), *sides,
        C.zero("duplicate_transformation").alias("duplicate_transformations"),
        C.zero("txn_missing_attempt_count").alias("missing_attempts"),
        C.zero("excluded_txn").alias("excluded_transactions"),
        C.zero("already_reported_count").alias("already_reported"), C.zero("activity_missing").alias("activity_missing"),
        C.zero("soft_dedup_dropped_txn_count").alias("soft_dedup_dropped"),
    )


def batch_investigation_queue(recon: DataFrame, batch_info: DataFrame, p: Period) -> DataFrame:
    """Batches that are not healthy, worst first."""
    level = C.health_five_level()
    rank = F.when(level == "Failed", 1).when(level == "Critical", 2).when(level == "Warning", 3).otherwise(4)
    return (
        with_batch_info(latest_batch(recon, p), batch_info)
        .withColumns({"health": level, "_rank": rank})
        .filter(F.col("health") != "Healthy")
        .orderBy(
            "_rank", F.desc(F.abs(C.gap("reportable"))), F.desc(C.zero("activity_transformation_failed")),
            F.desc_nulls_last("modified_timestamp"), "rpt_grp_id", "batch_id",
        )
        .select(
            *GROUP, "batch_id", "seq_no", "health", C.gap("reportable").alias("reportable_diff"),
            C.gap("transformation").alias("transformation_diff"),
            C.zero("activity_transformation_failed").alias("transformation_failures"),
            C.zero("txn_missing_attempt_count").alias("missing_attempts"),
            C.zero("duplicate_transformation").alias("duplicate_transformations"),
            "batch_status", "compiler_status", "report_status", "process_timestamp",
        )
    )
