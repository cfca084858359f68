"""Drill-down into the processing journey of batches and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import markers as M
from tallyline.functions.period import Period, narrow
from tallyline.operators.snapshots import latest, latest_batch, latest_stage

STATE = ("identifier", "mtcn", "rpt_grp_id", "batch_id", "stage", "status", "comments", "skip_reason")
STAMPS = ("created_timestamp", "modified_timestamp")
BATCH_KEY = ("rpt_grp_id", "batch_id")
# Ends every sort of detail rows: many share one time, and a range sort can only split
# a value across tasks when something else orders its rows.
ROW_KEY = ("rpt_grp_id", "batch_id", "identifier", "stage")


def stage_status(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    """Distinct transactions by stage and status, from the latest state of each stage."""
    return (
        latest_stage(journey, rpt_grp_id, batch_id)
        .groupBy("stage", "status")
        .agg(F.count_distinct("identifier").alias("transaction_count"))
        .orderBy("stage", F.desc("transaction_count"))
    )


def failure_reasons(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    return (
        latest_stage(journey, rpt_grp_id, batch_id)
        .filter(M.needs_explaining())
        .groupBy("stage", M.reason_category().alias("reason_category"))
        .agg(F.count_distinct("identifier").alias("affected_transactions"))
        .orderBy(F.desc("affected_transactions"))
    )


def _detail(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*STATE, *STAMPS, *extra).orderBy(F.desc_nulls_last("modified_timestamp"), *ROW_KEY)


def transformation_failures(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    rows = latest_stage(journey, rpt_grp_id, batch_id).filter(M.transformation_failure())
    return _detail(rows, "processing_complete", "reporting_timestamp_latest", "txn_metadata")


def failed_transactions(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    """Rows with a failure status at any stage, as stored."""
    rows = narrow(journey, batch_id=batch_id, rpt_grp_id=rpt_grp_id).filter(M.failure_status())
    return _detail(rows, "reporting_timestamp_latest")


def attempt_not_received(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    return _detail(latest_stage(journey, rpt_grp_id, batch_id).filter(M.join_error()), "txn_metadata")


def join_problems(journey: DataFrame, batch_id: str | None = None, rpt_grp_id: int | None = None) -> DataFrame:
    rows = narrow(journey, batch_id=batch_id, rpt_grp_id=rpt_grp_id).filter(M.join_stopped())
    return _detail(rows, "txn_metadata")


def txn_journey(
    journey: DataFrame, batch_id: str | None = None, identifier: str | None = None, mtcn: str | None = None
) -> DataFrame:
    """All rows of a transaction by either key, oldest first; without a batch, of every batch."""
    rows = narrow(journey, batch_id=batch_id)
    tests: list[Column] = []
    if identifier is not None:
        tests.append(F.col("identifier") == identifier)
    if mtcn is not None:
        tests.append(F.col("mtcn") == mtcn)
    if tests:
        rows = rows.filter(tests[0] | tests[-1])
    return rows.select(
        *STATE, "processing_complete", *STAMPS, "reporting_timestamp_latest", "txn_metadata"
    ).orderBy(F.asc_nulls_last("created_timestamp"), F.asc_nulls_last("modified_timestamp"), *ROW_KEY)


def journey_profile(journey: DataFrame, p: Period) -> DataFrame:
    return (
        journey.filter(p.holds("created_timestamp"))
        .groupBy("stage", "status", "skip_reason")
        .agg(F.count("*").alias("record_count"))
        .orderBy("stage", "status", F.desc("record_count"))
    )


def journey_markers(journey: DataFrame) -> DataFrame:
    """Rows per batch that carry each marker."""
    flags = {
        "already_reported": M.already_reported(),
        "missing_attempt": M.missing_attempt(),
        "transformed": M.transformed(),
        "failed": M.failed(),
        "failed_and_skipped": M.failed(skipped_only=True),
        "generated": M.generated(),
    }
    return journey.groupBy(*BATCH_KEY).agg(
        F.count("*").alias("journey_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )


def txn_root_cause(
    journey: DataFrame,
    hits: DataFrame,
    audit: DataFrame,
    batch_id: str | None = None,
    rpt_grp_id: int | None = None,
    mtcn: str | None = None,
) -> DataFrame:
    """One row per transaction with its journey state, rule-hit and exclusion evidence.

    Evidence is looked up inside (group, batch) by mtcn and, where that finds nothing, by
    transaction key. Hits and audit rows are read once, put under both of their keys and
    reduced to one row per key; each transaction then looks up its two keys in one join
    and the answers meet again. A hot key costs partial sums, and no join multiplies rows.
    """
    t = latest_txn_state(narrow(journey, batch_id=batch_id, rpt_grp_id=rpt_grp_id, mtcn=mtcn))

    def keyed(df: DataFrame, mtcn_col: Column, text_col: Column) -> DataFrame:
        keys = F.array(
            F.struct(F.lit(1).alias("kind"), mtcn_col.alias("lookup")), F.struct(F.lit(2).alias("kind"), text_col.alias("lookup"))
        )
        return df.select("*", F.inline(keys))

    def evidence(df: DataFrame, batch: str, *cols: Column) -> DataFrame:
        rows = narrow(df, **{batch: batch_id, "rpt_grp_id": rpt_grp_id}).filter(F.col(batch).isNotNull())
        both = keyed(rows.withColumn("batch_id", F.col(batch)), F.col("mtcn"), F.col("external_txn_key").cast("string"))
        return both.filter("lookup IS NOT NULL").select(*BATCH_KEY, "kind", "lookup", *cols)

    reason = F.col("exclusion_reason_id")
    h = evidence(
        hits, "efile_batch_id", F.lit(1).alias("is_hit"), "rule_id", "external_txn_key", reason.alias("hit_reason"),
        "reported_batch_id",
    )
    a = evidence(audit, "processing_batch_id", F.lit(0).alias("is_hit"), reason.alias("audit_reason"), "exclusion_strategy")
    found = (
        h.unionByName(a, allowMissingColumns=True)
        .groupBy(*BATCH_KEY, "kind", "lookup")
        .agg(
            F.struct(
                F.sum("is_hit").alias("rows"), F.min("rule_id").alias("first_rule"), F.max("rule_id").alias("last_rule"),
                F.max("external_txn_key").alias("key"), F.max("hit_reason").alias("reason"),
                F.max("reported_batch_id").alias("reported_batch"),
            ).alias("hit"),
            F.struct(
                (F.count("*") - F.sum("is_hit")).alias("rows"), F.max("audit_reason").alias("reason"),
                F.max("exclusion_strategy").alias("strategy"),
            ).alias("audit"),
        )
    )
    shown = ("mtcn", "stage", "status", "comments", "skip_reason")
    looked = keyed(t.select(*BATCH_KEY, "identifier", *shown), F.col("mtcn"), F.col("identifier")).join(
        found, [*BATCH_KEY, "kind", "lookup"], "left"
    )

    def of(side: str, kind: int) -> Column:
        got = (F.col("kind") == kind) & (F.col(f"{side}.rows") > 0)
        return F.max(F.when(got, F.col(side))).alias(f"{side}_{kind}")

    per = looked.groupBy(*BATCH_KEY, "identifier").agg(
        F.max(F.struct(*shown)).alias("s"), *[of(side, kind) for side in ("hit", "audit") for kind in (1, 2)]
    )
    hit, aud = F.coalesce("hit_1", "hit_2"), F.coalesce("audit_1", "audit_2")
    via = F.when(F.col("hit_1").isNotNull(), "mtcn").when(F.col("hit_2").isNotNull(), "identifier")
    nothing = F.lit(0).cast("bigint")
    return per.select(
        *BATCH_KEY, "identifier", "s.*", via.alias("bridge"),
        F.coalesce(hit["rows"], nothing).alias("rule_hit_rows"), hit["first_rule"].alias("first_rule_id"),
        hit["last_rule"].alias("last_rule_id"), hit["key"].alias("external_txn_key"),
        hit["reason"].alias("hit_exclusion_reason"), hit["reported_batch"].alias("reported_batch_id"),
        F.coalesce(aud["rows"], nothing).alias("audit_rows"), aud["reason"].alias("audit_exclusion_reason"),
        aud["strategy"].alias("audit_exclusion_strategy"),
    )


def latest_txn_state(journey: DataFrame) -> DataFrame:
    """Latest row per (group, batch, transaction), whatever its stage."""
    return latest(journey, (*BATCH_KEY, "identifier"), ("modified_timestamp", "created_timestamp", "stage"))


def evidence_tabs(
    batch_recon: DataFrame, journey: DataFrame, hits: DataFrame, audit: DataFrame, p: Period
) -> DataFrame:
    """Which evidence exists per batch. Detail tables shrink to their batch keys before the join."""
    out = latest_batch(batch_recon, p).select(*BATCH_KEY)
    for df, batch, name in (
        (journey, "batch_id", "has_journey"),
        (hits, "efile_batch_id", "has_rule_hits"),
        (audit, "processing_batch_id", "has_exclusions"),
    ):
        keys = df.select("rpt_grp_id", F.col(batch).alias("batch_id")).distinct().withColumn(name, F.lit(True))
        out = out.join(keys, list(BATCH_KEY), "left").withColumn(name, F.col(name).isNotNull())
    return out
