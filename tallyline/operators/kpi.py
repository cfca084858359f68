"""Headline figures over batch and rule-hit reconciliation snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import controls as C
from tallyline.functions.aggregates import distinct_if, percent, total
from tallyline.functions.period import Period
from tallyline.operators.snapshots import latest_batch, latest_recon

GROUP = ("rpt_grp_id", "rpt_grp_name")

HIT_TOTALS = (
    ("distinct_rule_hits_count_source", "expected"),
    ("distinct_rule_hits_count_target", "matched"),
    ("missed_rule_hits_count_target", "missed"),
)


def hit_totals(suffix: str = "") -> list:
    return [total(c, n + suffix) for c, n in HIT_TOTALS]


def with_match_rate(df: DataFrame, suffix: str = "") -> DataFrame:
    return df.withColumn("match_rate_pct", percent(F.col("matched" + suffix), F.col("expected" + suffix)))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side."""
    wide = frames[0]
    for f in frames[1:]:
        wide = wide.unionByName(f, allowMissingColumns=True)
    names = [c for f in frames for c in f.columns]
    return wide.agg(*[F.max(c).alias(c) for c in names])


def kpi_cards(batch_recon: DataFrame, p: Period) -> DataFrame:
    """Batches and groups run, batches with issues, and failures, counted by batch_id."""
    return latest_batch(batch_recon, p).agg(
        F.count_distinct("batch_id").alias("batches_run"),
        F.count_distinct("rpt_grp_id").alias("report_groups_run"),
        distinct_if("batch_id", C.has_issue(), "batches_with_issues"),
        total("activity_transformation_failed", "transformation_failures"),
        distinct_if("batch_id", C.recon_broken(), "reconciliation_issue_batches"),
    )


def rule_recon_totals(hit_recon: DataFrame, p: Period, rpt_grp_id: int | None = None) -> DataFrame:
    sums = latest_recon(hit_recon, p, rpt_grp_id).agg(*hit_totals("_rule_hits"))
    return with_match_rate(sums, "_rule_hits")


def hit_total(hit_recon: DataFrame, p: Period, which: str) -> DataFrame:
    """One of the expected, matched or missed totals."""
    column = {n: c for c, n in HIT_TOTALS}[which]
    return latest_recon(hit_recon, p).agg(total(column, f"{which}_rule_hits"))


def dashboard_summary(batch_recon: DataFrame, hit_recon: DataFrame, p: Period) -> DataFrame:
    batches = kpi_cards(batch_recon, p)
    hits = latest_recon(hit_recon, p).agg(*hit_totals("_rule_hits"))
    return _one_row(batches, hits)


def batch_health(batch_recon: DataFrame, p: Period) -> DataFrame:
    labelled = latest_batch(batch_recon, p).select(
        "batch_id", C.health().alias("health_status"), C.health_rank().alias("_rank")
    )
    return (
        labelled.groupBy("health_status")
        .agg(F.count_distinct("batch_id").alias("batch_count"), F.min("_rank").alias("_rank"))
        .orderBy("_rank")
        .drop("_rank")
    )


def issues_by_type(batch_recon: DataFrame, p: Period) -> DataFrame:
    """Batches affected per kind of issue, zero counts included; one pass, then unpivot."""
    kinds = C.issue_kinds()
    wide = latest_batch(batch_recon, p).agg(*[distinct_if("batch_id", cond, kind) for kind, cond in kinds.items()])
    return wide.unpivot([], list(kinds), "issue_type", "affected_batches").orderBy(F.desc("affected_batches"))


def report_group_health(batch_recon: DataFrame, hit_recon: DataFrame, p: Period) -> DataFrame:
    per_group = latest_batch(batch_recon, p).groupBy(*GROUP).agg(
        F.count_distinct("batch_id").alias("batches_run"),
        distinct_if("batch_id", C.has_issue(), "issue_batches"),
        total("activity_transformation_failed", "transformation_failures"),
        F.max("created_timestamp").alias("latest_batch_timestamp"),
    )
    hits = latest_recon(hit_recon, p).groupBy("rpt_grp_id").agg(*hit_totals("_rule_hits"))
    names = [f"{n}_rule_hits" for _, n in HIT_TOTALS]
    return (
        per_group.join(hits, "rpt_grp_id", "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names})
        .withColumn("healthy_batches", F.col("batches_run") - F.col("issue_batches"))
        .select(
            *GROUP, "batches_run", "healthy_batches", "issue_batches", *names,
            "transformation_failures", "latest_batch_timestamp",
        )
        .orderBy(F.desc("issue_batches"), F.desc("missed_rule_hits"))
    )


def operations_trend(batch_recon: DataFrame, p: Period) -> DataFrame:
    return (
        latest_batch(batch_recon, p)
        .groupBy(F.to_date("created_timestamp").alias("day"))
        .agg(
            F.count_distinct("batch_id").alias("batches_run"),
            distinct_if("batch_id", C.has_issue(), "issue_batches"),
            total("activity_transformation_failed", "transformation_failures"),
        )
        .orderBy("day")
    )


def recon_trend(hit_recon: DataFrame, p: Period) -> DataFrame:
    return latest_recon(hit_recon, p).groupBy("run_date").agg(*hit_totals()).orderBy("run_date")


def recon_by_group(hit_recon: DataFrame, p: Period) -> DataFrame:
    sums = latest_recon(hit_recon, p).groupBy(*GROUP).agg(*hit_totals())
    return with_match_rate(sums).orderBy(F.desc("missed"), "rpt_grp_name")


def recon_group_runs(hit_recon: DataFrame, p: Period, rpt_grp_id: int | None = None) -> DataFrame:
    """Latest row per run date of one group (of every group when none is named)."""
    return (
        latest_recon(hit_recon, p, rpt_grp_id)
        .select(
            *GROUP, "run_date", "seq_no", *[F.col(c).alias(n) for c, n in HIT_TOTALS],
            "rule_hit_publish_count_source", "modified_timestamp",
        )
        .orderBy(F.desc("run_date"), "rpt_grp_id")
    )


def kpi_groups(batch_recon: DataFrame, hit_recon: DataFrame, batch_info: DataFrame, p: Period) -> DataFrame:
    """Operational coverage, rule-hit coverage and exceptions in one row.

    Batches are counted by (group, batch), the key of a run.
    """
    run = with_batch_info(latest_batch(batch_recon, p), batch_info)
    level = C.health_five_level()
    ops = run.agg(
        F.count("*").alias("batches_run"),
        F.count_distinct("rpt_grp_id").alias("report_groups_run"),
        F.count_if(C.has_issue()).alias("batches_with_issues"),
        F.count_if(level.isin("Critical", "Failed")).alias("critical_or_failed_batches"),
        total("txn_missing_attempt_count", "missing_attempts"),
        total("activity_transformation_failed", "transformation_failures"),
        total("duplicate_transformation", "duplicate_transformations"),
        F.count_if(C.recon_broken()).alias("reconciliation_issue_batches"),
        F.count_if(C.imbalanced()).alias("control_imbalance_batches"),
    )
    hits = with_match_rate(latest_recon(hit_recon, p).agg(*hit_totals("_rule_hits")), "_rule_hits")
    return _one_row(ops, hits)


def with_batch_info(batches: DataFrame, batch_info: DataFrame) -> DataFrame:
    """Operational times and statuses on the full batch key; batches without any are kept."""
    info = batch_info.select(
        "rpt_grp_id", "batch_id", "seq_no", "process_timestamp", "batch_status", "compiler_status", "report_status",
        F.col("created_timestamp").alias("batch_info_created_timestamp"),
        F.lit(True).alias("has_batch_info"),
    )
    return batches.join(info, ["rpt_grp_id", "batch_id", "seq_no"], "left")


def report_group_health_full(
    batch_recon: DataFrame, hit_recon: DataFrame, batch_info: DataFrame, config: DataFrame, p: Period
) -> DataFrame:
    """One row per group with country, counters and the worst health of its batches."""
    rank = {"Failed": 5, "Critical": 4, "In Progress": 3, "Warning": 2, "Healthy": 1}
    level = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    run = with_batch_info(latest_batch(batch_recon, p), batch_info).withColumn("health", C.health_five_level())
    per_group = run.groupBy(*GROUP).agg(
        F.count("*").alias("batches_run"),
        F.count_if(C.has_issue()).alias("batches_with_issues"),
        total("txn_missing_attempt_count", "missing_attempts"),
        total("activity_transformation_failed", "transformation_failures"),
        total("duplicate_transformation", "duplicate_transformations"),
        F.count_if(C.recon_broken()).alias("reconciliation_issues"),
        F.max_by("health", level[F.col("health")]).alias("health"),
    )
    hits = with_match_rate(latest_recon(hit_recon, p).groupBy("rpt_grp_id").agg(*hit_totals("_rule_hits")), "_rule_hits")
    names = [f"{n}_rule_hits" for _, n in HIT_TOTALS]
    return (
        per_group.join(hits, "rpt_grp_id", "left")
        .join(config.select("rpt_grp_id", F.col("country_name").alias("country")), "rpt_grp_id", "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names})
        .select(
            *GROUP, "country", "batches_run", "batches_with_issues", *names, "match_rate_pct", "missing_attempts",
            "transformation_failures", "duplicate_transformations", "reconciliation_issues", "health",
        )
    )
