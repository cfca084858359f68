"""Data-quality checks. Each returns named sections: a one-row summary and flat lists.

Sample lists are top-k reports by definition, with ties broken by the batch key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import controls as C
from tallyline.functions import markers as M
from tallyline.functions.aggregates import count_if, sure_total, total
from tallyline.functions.period import Period
from tallyline.operators.kpi import GROUP, with_batch_info
from tallyline.operators.snapshots import latest_batch, latest_recon

Sections = dict[str, DataFrame]
KEY = ("rpt_grp_id", "batch_id")
RUN = ("rpt_grp_id", "run_date", "seq_no")
NULL_LABEL = "<NULL>"


def labelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_LABEL))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value of each column, nulls labelled, in long form."""
    long = df.select(*[labelled(c).alias(c) for c in columns]).unpivot([], list(columns), "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("row_count"))


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Rows in order; the first ``k`` of them, or all."""
    rows = df.orderBy(*order)
    return rows if k is None else rows.limit(k)


def run_keys(df: DataFrame, p: Period) -> DataFrame:
    """Distinct (group, batch) pairs of the period."""
    return df.filter(p.holds("created_timestamp") & F.col("batch_id").isNotNull()).select(*KEY).distinct()


def batch_join_time(batch_recon: DataFrame, batch_info: DataFrame, p: Period, k: int | None = None) -> Sections:
    j = with_batch_info(latest_batch(batch_recon, p), batch_info)
    there = F.col("has_batch_info").isNotNull()
    inside = p.holds("process_timestamp")
    matched = j.filter(there)
    return {
        "summary": j.agg(
            F.count("*").alias("transformation_batches"),
            count_if(there, "exact_batch_info_matches"),
            count_if(~there, "unmatched_batches"),
            count_if(there & F.col("process_timestamp").isNull(), "process_timestamp_null"),
            count_if(inside, "process_timestamp_inside"),
            count_if(~inside, "process_timestamp_outside"),
        ),
        "status": value_counts(matched, "batch_status"),
        "unmatched": top(
            j.filter(~there).select(*GROUP, "batch_id", "seq_no", "created_timestamp"),
            k, F.desc("created_timestamp"), *KEY,
        ),
        "timing": top(
            matched.select(
                *GROUP, "batch_id", "seq_no", F.col("created_timestamp").alias("reconciliation_created_timestamp"),
                "process_timestamp", "batch_info_created_timestamp", "batch_status", "compiler_status", "report_status",
            ),
            k, F.desc_nulls_last("process_timestamp"), *KEY,
        ),
    }


BATCH_CONTROLS = ("reportable", "lookback", "reporting_period", "activity", "transformation", "transformation_with_dup")


def balance_counts(df: DataFrame, controls: tuple[str, ...]) -> DataFrame:
    """Balanced and unbalanced batches and the largest difference per control, in one pass."""
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(C.gap(c) == 0).alias(f"b_{c}") for c in controls],
        *[F.max(F.abs(C.gap(c))).alias(f"m_{c}") for c in controls],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("control"), F.col(f"b_{c}").alias("balanced"), F.col(f"m_{c}").alias("max_difference")) for c in controls]
    )
    return wide.select("n", F.inline(rows)).select(
        "control", "balanced", (F.col("n") - F.col("balanced")).alias("unbalanced"), "max_difference"
    )


def control_equations(batch_recon: DataFrame, p: Period, k: int | None = None) -> Sections:
    b = latest_batch(batch_recon, p)
    back = -C.gap("reportable")
    bad = C.any_gap("reportable", "activity", "transformation")
    return {
        "summary": balance_counts(b, BATCH_CONTROLS),
        "mismatches": top(
            b.filter(bad).select(
                *GROUP, "batch_id", "expected_reportable_txn", "actual_reportable_txn",
                back.alias("reportable_difference"), "activity_selected", "lookback_txn", "reporting_period_txn",
                "activity_simulated", "actual_activity_eligible_for_transformation", "activity_transformed",
                "activity_transformation_failed", "duplicate_transformation",
                C.gap("transformation").alias("transformation_difference"),
            ),
            k, F.desc(F.abs("reportable_difference")), *KEY,
        ),
    }


FUTURE = ("lookback_future_reporting_txn", "reporting_period_future_reporting_txn")
WINDOWS = (
    "lookback_txn", "lookback_actual_txn", FUTURE[0], "reporting_period_txn", "reporting_period_actual_txn", FUTURE[1],
)


def future_reporting(batch_recon: DataFrame, p: Period, k: int | None = None) -> Sections:
    b = latest_batch(batch_recon, p)
    ahead = C.zero(FUTURE[0]) + C.zero(FUTURE[1])
    return {
        "summary": b.agg(
            F.count("*").alias("total_batches"),
            count_if(C.zero(FUTURE[0]) > 0, "batches_with_lookback_future_reporting"),
            count_if(C.zero(FUTURE[1]) > 0, "batches_with_reporting_period_future_reporting"),
            count_if(ahead > 0, "batches_with_any_future_reporting"),
            *[sure_total(c, f"sum_{c}") for c in WINDOWS],
        ),
        "largest": top(
            b.filter(ahead > 0).select(*GROUP, "batch_id", *WINDOWS, ahead.alias("total_future_reporting")),
            k, F.desc("total_future_reporting"), *KEY,
        ),
    }


def against_journey(
    batch_recon: DataFrame, journey: DataFrame, p: Period, pairs: dict[str, tuple[str, Column]], k: int | None = None
) -> Sections:
    """Compare batch counters with marker rows in the journey.

    ``pairs`` maps a short name to the counter column and the marker. Journey rows are
    summed per batch before they meet the batches.
    """
    counters = [c for c, _ in pairs.values()]
    marks = journey.groupBy(*KEY).agg(
        F.count("*").alias("journey_rows"), *[F.count_if(m).alias(f"{n}_rows") for n, (_, m) in pairs.items()]
    )
    none = F.lit(0).cast("bigint")
    names = ["journey_rows", *[f"{n}_rows" for n in pairs]]
    cmp = (
        latest_batch(batch_recon, p)
        .select(*GROUP, "batch_id", *counters)
        .join(marks, list(KEY), "left")
        .withColumns({n: F.coalesce(F.col(n), none) for n in names})
    )
    has = F.col("journey_rows") > 0
    facts = [F.count("*").alias("total_batches"), count_if(has, "batches_with_any_journey")]
    wrong = []
    for n, (counter, _) in pairs.items():
        same = C.zero(counter) == F.col(f"{n}_rows")
        wrong.append(~same)
        facts += [
            count_if(C.zero(counter) > 0, f"{n}_metric_nonzero"),
            count_if(same, f"{n}_balanced"),
            count_if(has & same, f"{n}_balanced_with_journey"),
            count_if((C.zero(counter) > 0) & (F.col(f"{n}_rows") == 0), f"{n}_metric_without_marker"),
        ]
    bad = reduce(lambda a, b: a | b, wrong)
    return {
        "summary": cmp.agg(*facts),
        "mismatches": top(
            cmp.filter(bad).select(*GROUP, "batch_id", *counters, *names), k, F.desc(C.zero(counters[-1])), *KEY
        ),
    }


def already_reported(batch_recon: DataFrame, journey: DataFrame, p: Period) -> Sections:
    return against_journey(batch_recon, journey, p, {"already_reported": ("already_reported_count", M.already_reported())})


def missing_attempt(batch_recon: DataFrame, journey: DataFrame, p: Period) -> Sections:
    return against_journey(batch_recon, journey, p, {"missing_attempt": ("txn_missing_attempt_count", M.missing_attempt())})


def transformed_failed(batch_recon: DataFrame, journey: DataFrame, p: Period) -> Sections:
    return against_journey(
        batch_recon, journey, p,
        {
            "transformed": ("activity_transformed", M.transformed()),
            "failed": ("activity_transformation_failed", M.failed(skipped_only=True)),
        },
    )


def duplicates(batch_recon: DataFrame, p: Period, k: int | None = None) -> Sections:
    b = latest_batch(batch_recon, p)
    dup = C.zero("duplicate_transformation") > 0
    return {
        "summary": b.agg(
            F.count("*").alias("total_batches"), count_if(dup, "batches_with_duplicates"),
            sure_total("duplicate_transformation", "total_duplicates"),
        ),
        "largest": top(
            b.filter(dup).select(
                *GROUP, "batch_id", "duplicate_transformation", "activity_transformed", "activity_transformation_failed"
            ),
            k, F.desc("duplicate_transformation"), *KEY,
        ),
    }


def rule_hit_linkage(hits: DataFrame, batch_recon: DataFrame, p: Period) -> DataFrame:
    """Rule hits whose efile batch ran in the period. Hits are summed per batch key first,
    so a batch holding a third of them is one row in the join."""
    f = F.col("is_reported")
    per = hits.groupBy("rpt_grp_id", F.col("efile_batch_id").alias("batch_id")).agg(
        F.count("*").alias("n"), F.count_if(~f).alias("no"), F.count_if(f).alias("yes"), F.count_if(f.isNull()).alias("unknown")
    )
    return per.join(run_keys(batch_recon, p), list(KEY)).agg(
        sure_total("n", "rule_hit_rows"),
        F.count("*").alias("distinct_batches"),
        sure_total("no", "is_reported_false"),
        sure_total("yes", "is_reported_true"),
        sure_total("unknown", "is_reported_null"),
    )


def exclusion_audit(audit: DataFrame, batch_recon: DataFrame, p: Period) -> Sections:
    per = audit.groupBy(
        "rpt_grp_id", F.col("processing_batch_id").alias("batch_id"), labelled("exclusion_reason_id").alias("reason")
    ).agg(F.count("*").alias("n"))
    scoped = per.join(run_keys(batch_recon, p), list(KEY))
    per_batch = scoped.groupBy(*KEY).agg(F.sum("n").alias("n"))
    return {
        "summary": per_batch.agg(sure_total("n", "audit_rows"), F.count("*").alias("distinct_batches")),
        "reasons": scoped.groupBy("reason").agg(F.sum("n").alias("row_count")),
    }


def recon_grains(hit_recon: DataFrame, p: Period) -> Sections:
    s = hit_recon.filter(p.holds("created_timestamp"))
    return {
        "summary": s.agg(
            F.count("*").alias("total_rows"),
            F.count_distinct("rpt_grp_id").alias("distinct_report_groups"),
            F.count_distinct(F.struct(*RUN)).alias("distinct_runs"),
            count_if(C.rule_hit_gap() == 0, "balanced_rows"),
            count_if(C.rule_hit_gap() != 0, "unbalanced_rows"),
            sure_total("distinct_rule_hits_count_source", "expected_rule_hits"),
            sure_total("distinct_rule_hits_count_target", "matched_rule_hits"),
            sure_total("missed_rule_hits_count_target", "missed_rule_hits"),
        ),
        "groups": s.groupBy(F.coalesce("rpt_grp_name", F.col("rpt_grp_id").cast("string")).alias("report_group")).agg(
            F.count("*").alias("row_count")
        ),
    }


def batch_status_values(batch_info: DataFrame, p: Period) -> DataFrame:
    return value_counts(
        batch_info.filter(p.holds("process_timestamp")), "batch_status", "compiler_status", "report_status"
    )


def _three_valued(flag: str, prefix: str) -> list[Column]:
    c = F.col(flag)
    return [count_if(c, f"{prefix}_true"), count_if(~c, f"{prefix}_false"), count_if(c.isNull(), f"{prefix}_null")]


def recon_detail_populations(log: DataFrame, analysis: DataFrame, unprocessed: DataFrame, p: Period) -> Sections:
    runs = F.count_distinct(F.struct("run_date", "seq_no", "rpt_grp_id")).alias("distinct_runs")
    groups = F.count_distinct("rpt_grp_id").alias("distinct_report_groups")
    rows = F.count("*").alias("row_count")
    lg, an, un = (d.filter(p.holds("created_timestamp")) for d in (log, analysis, unprocessed))
    return {
        "log": lg.agg(rows, runs, groups, *_three_valued("is_processed", "processed"), *_three_valued("is_reported", "reported")),
        "log_values": value_counts(lg, "status", "data_source"),
        "analysis": an.agg(rows, runs, groups),
        "analysis_values": value_counts(an, "description"),
        "unprocessed": un.agg(rows, groups, *_three_valued("is_reported", "reported")),
        "unprocessed_values": value_counts(un, "status", "data_source"),
    }


def _recon_figures(hit_recon: DataFrame) -> DataFrame:
    return hit_recon.select(
        *RUN, "rpt_grp_name", F.col("distinct_rule_hits_count_source").alias("expected_rule_hits"),
        F.col("distinct_rule_hits_count_target").alias("matched_rule_hits"),
        F.col("missed_rule_hits_count_target").alias("missed_rule_hits"),
    )


def _left_counts(df: DataFrame, side: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Left join counts, with a missing row read as zero."""
    none = F.lit(0).cast("bigint")
    names = [c for c in side.columns if c not in on]
    return df.join(side, list(on), "left").withColumns({n: F.coalesce(F.col(n), none) for n in names})


def recon_detail_linkage(hit_recon: DataFrame, log: DataFrame, analysis: DataFrame, p: Period, k: int | None = None) -> Sections:
    pro, rep = F.col("is_processed"), F.col("is_reported")
    lg = log.groupBy(*RUN).agg(
        F.count("*").alias("log_rows"), F.count_distinct("external_txn_key").alias("log_distinct_transactions"),
        F.count_distinct("rule_id").alias("log_distinct_rules"), count_if(pro, "log_processed_rows"),
        count_if(~pro, "log_unprocessed_rows"), count_if(rep, "log_reported_rows"), count_if(~rep, "log_not_reported_rows"),
    )
    an = analysis.groupBy(*RUN).agg(
        F.count("*").alias("analysis_rows"), F.count_distinct("txn_sur_key").alias("analysis_distinct_transactions"),
        F.count_distinct("rule_id").alias("analysis_distinct_rules"),
    )
    j = _left_counts(_left_counts(_recon_figures(hit_recon.filter(p.holds("created_timestamp"))), lg, RUN), an, RUN)
    seen, studied, missed = F.col("log_rows") > 0, F.col("analysis_rows") > 0, F.col("missed_rule_hits") > 0
    return {
        "summary": j.agg(
            F.count("*").alias("reconciliation_rows"),
            count_if(seen, "rows_with_log_evidence"), count_if(~seen, "rows_without_log_evidence"),
            count_if(studied, "rows_with_analysis_evidence"), count_if(~studied, "rows_without_analysis_evidence"),
            count_if(missed, "rows_with_misses"), count_if(missed & seen, "miss_rows_with_log_evidence"),
            count_if(missed & studied, "miss_rows_with_analysis_evidence"),
        ),
        "samples": top(j, k, F.desc("missed_rule_hits"), F.desc("expected_rule_hits"), *RUN),
    }


def missed_hit_evidence(
    hit_recon: DataFrame, log: DataFrame, analysis: DataFrame, unprocessed: DataFrame, p: Period, k: int | None = None
) -> Sections:
    pro, rep = F.col("is_processed"), F.col("is_reported")
    lg = log.groupBy(*RUN).agg(
        F.count("*").alias("log_rows"), count_if(~pro, "log_not_processed"), count_if(~rep, "log_not_reported"),
        count_if(~pro & ~rep, "log_not_processed_not_reported"),
        count_if(F.col("exclusion_reason_id").isNotNull(), "log_excluded"),
        count_if(F.col("future_reporting_date").isNotNull(), "log_future_reporting"),
    )
    an = analysis.groupBy(*RUN).agg(F.count("*").alias("analysis_rows"))
    un = unprocessed.filter(p.holds("created_timestamp")).groupBy("rpt_grp_id").agg(
        F.count("*").alias("unprocessed_rows"), count_if(~rep, "unprocessed_not_reported"),
        count_if(F.col("exclusion_reason_id").isNotNull(), "unprocessed_excluded"),
    )
    missing = hit_recon.filter(p.holds("created_timestamp") & (C.zero("missed_rule_hits_count_target") > 0))
    j = _left_counts(_left_counts(_left_counts(_recon_figures(missing), lg, RUN), an, RUN), un, ("rpt_grp_id",))
    miss = F.col("missed_rule_hits")
    candidates = ("log_not_processed", "log_not_reported", "log_not_processed_not_reported", "analysis_rows")
    return {
        "summary": j.agg(
            F.count("*").alias("reconciliation_rows_with_misses"),
            sure_total("expected_rule_hits", "total_expected_rule_hits"),
            sure_total("matched_rule_hits", "total_matched_rule_hits"),
            sure_total("missed_rule_hits", "total_missed_rule_hits"),
            *[count_if(F.col(c) == miss, f"rows_where_{c}_equals_missed") for c in candidates],
        ),
        "samples": top(j, k, F.desc("missed_rule_hits"), *RUN),
    }


def report_generation(
    batch_recon: DataFrame, journey: DataFrame, batch_info: DataFrame, p: Period, k: int | None = None
) -> Sections:
    done = journey.filter(M.generated()).groupBy(*KEY).agg(F.count_distinct("identifier").alias("generated_txn"))
    base = with_batch_info(latest_batch(batch_recon, p), batch_info).withColumn("actual", C.zero("actual_reportable_txn"))
    j = _left_counts(base, done, KEY).withColumn("difference", F.col("generated_txn") - F.col("actual"))
    g, a = F.col("generated_txn"), F.col("actual")
    complete = F.col("compiler_status").eqNullSafe(M.GENERATION_DONE)
    return {
        "summary": j.agg(
            F.count("*").alias("total_batches"), count_if(g > 0, "batches_with_generation_evidence"),
            count_if(a > 0, "batches_with_actual_reportable"), count_if(g == a, "exact_match_batches"),
            count_if(g < a, "generated_less_than_actual"), count_if(g > a, "generated_greater_than_actual"),
            F.sum("actual").alias("sum_actual_reportable"), F.sum("generated_txn").alias("sum_generated"),
            count_if(complete & (g == 0), "completed_with_zero_generated"),
            count_if(~complete & (g > 0), "generated_but_not_completed"),
        ),
        "compiler": j.groupBy(labelled("compiler_status").alias("compiler_status")).agg(
            F.sum("generated_txn").alias("generated_txn")
        ),
        "mismatches": top(
            j.select(
                *GROUP, "batch_id", "seq_no", F.col("actual").alias("actual_reportable_txn"), "generated_txn", "difference",
                "report_status", "compiler_status", "batch_status",
            ),
            k, F.desc(F.abs("difference")), *KEY,
        ),
    }


def rule_hit_recon(hit_recon: DataFrame, p: Period) -> Sections:
    src, tgt = C.zero("distinct_rule_hits_count_source"), C.zero("distinct_rule_hits_count_target")
    rows = latest_recon(hit_recon, p).select(
        *GROUP, "run_date", "seq_no", "distinct_rule_hits_count_source", "rule_hit_publish_count_source",
        "distinct_rule_hits_count_target", "missed_rule_hits_count_target",
        (src - tgt).alias("distinct_minus_matched"),
        (C.zero("rule_hit_publish_count_source") - tgt).alias("publish_minus_matched"),
        (-C.rule_hit_gap()).alias("variance_vs_distinct"),
        C.rule_hit_publish_gap().alias("variance_vs_publish"),
    )
    d, u = F.col("variance_vs_distinct"), F.col("variance_vs_publish")
    return {
        "summary": rows.agg(
            F.count("*").alias("total_reconciliation_rows"),
            count_if(d == 0, "distinct_equation_balances"), count_if(d != 0, "distinct_equation_fails"),
            count_if(u == 0, "publish_equation_balances"), count_if(u != 0, "publish_equation_fails"),
        ),
        "rows": rows.orderBy("rpt_grp_name", *RUN),
    }


def transformation_waterfall(batch_recon: DataFrame, p: Period) -> Sections:
    sel, dis = C.gap("selection"), C.gap("transformation_with_dup")
    b = latest_batch(batch_recon, p)
    return {
        "summary": balance_counts(b, ("selection", "transformation_with_dup")),
        "details": b.select(
            "batch_id", *GROUP, "txn_selected", "excluded_txn", "txn_missing_attempt_count", "already_reported_count",
            "expected_reportable_txn", sel.alias("selection_balance_diff"),
            "actual_activity_eligible_for_transformation", "activity_transformed", "activity_transformation_failed",
            "duplicate_transformation", dis.alias("transformation_balance_diff"),
        ).orderBy(F.desc(F.abs("selection_balance_diff")), F.desc(F.abs("transformation_balance_diff")), *KEY),
    }


CANDIDATE_FIELDS = (
    "txn_simulated", "lookback_txn", "lookback_future_reporting_txn", "lookback_actual_txn", "reporting_period_txn",
    "reporting_period_future_reporting_txn", "reporting_period_actual_txn", "activity_selected", "activity_missing",
    "activity_simulated",
)


def selection_balance(batch_recon: DataFrame, p: Period, k: int | None = None) -> Sections:
    """Batches whose selection does not add up, with totals of fields that might explain it.

    The totals always cover every such batch; ``k`` shortens the list alone.
    """
    diff = C.gap("selection")
    bad = latest_batch(batch_recon, p).filter(diff != 0).withColumn("selection_balance_diff", diff)
    order = (F.desc(F.abs("selection_balance_diff")), *KEY)
    return {
        "summary": bad.agg(
            F.count("*").alias("unbalanced_batches"),
            F.max(F.abs("selection_balance_diff")).alias("max_selection_difference"),
            *[total(c) for c in CANDIDATE_FIELDS],
        ),
        "top": top(
            bad.select(
                "batch_id", *GROUP, "selection_balance_diff", "txn_selected", "excluded_txn",
                "txn_missing_attempt_count", "already_reported_count", "expected_reportable_txn", *CANDIDATE_FIELDS,
            ),
            k, *order,
        ),
    }


RELATED = ("expected_vs_selected", "activity", "lookback", "reporting_period", "transformation_with_dup")


def control_relationships(batch_recon: DataFrame, p: Period) -> Sections:
    b = latest_batch(batch_recon, p)
    return {
        "summary": balance_counts(b, RELATED),
        "exceptions": b.filter(C.any_gap(*RELATED)).select(
            "batch_id", *GROUP, "expected_reportable_txn", "activity_selected", "lookback_txn", "reporting_period_txn",
            *[C.gap(c).alias(f"{c}_diff") for c in RELATED],
        ).orderBy(F.desc(F.abs("activity_diff")), F.desc(F.abs("expected_vs_selected_diff")), *KEY),
    }
