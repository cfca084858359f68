"""Named queries: each builds one operator's result over the derived tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.controls import EQUATIONS, gap, health_five_level, rule_hit_gap, rule_hit_publish_gap
from tallyline.functions.hits import open_at, reported_by
from tallyline.functions.period import Period, narrow, previous_month_of, previous_week_of
from tallyline.operators import batches, bridges, cases, filters, hits, journey, kpi, lifecycle, metrics, snapshots, transform, validation
from tallyline.operators.snapshots import latest_batch, latest_recon
from tallyline.sources import sinks
from tallyline.sources.derived import Tables, case_events, stage_results, submissions
from tallyline.sources.tables import schema
from tallyline.streaming import lifecycle as streams

# The reporting period of the registered queries: four months in the middle of the test
# data, so that every period filter removes rows. Hits are still open on its last day.
PERIOD = Period(date(1996, 6, 1), date(1996, 9, 30))
AS_OF = datetime(2024, 1, 25)
STREAM_AS_OF = datetime(2024, 1, 1, 12, 30)

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}


def plan(name: str, build: Plan) -> None:
    PLANS[name] = build


def parts(name: str, names: str, build: Callable[[Tables], dict[str, DataFrame]]) -> None:
    """Register each named section of a check; ``summary`` goes under the plain name."""
    for part in names.split():
        PLANS[name if part == "summary" else f"{name}__{part}"] = lambda t, part=part: build(t)[part]


P = PERIOD

# Shared blocks


def _periods(t: Tables, bounds) -> DataFrame:
    days = t.base("orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    first, last = bounds(F.col("as_of"))
    return days.select("as_of", first.alias("start_date"), last.alias("end_date"))


HIT_KEY = ("rpt_grp_id", "bucket_id", "rule_id", "attempt_id")
plan("period", lambda t: _periods(t, previous_week_of))
plan("period_prev_month", lambda t: _periods(t, previous_month_of))
plan("in_period", lambda t: t.hits.filter(P.holds("transaction_date")).select(*HIT_KEY))
plan("is_open", lambda t: t.hits.filter(open_at(P)).select(*HIT_KEY))
plan("is_reported_asof", lambda t: t.hits.filter(reported_by(P)).select(*HIT_KEY))

plan("opt", lambda t: narrow(t.batch_recon, rpt_grp_id=None, batch_id=None).select("rpt_grp_id", "batch_id", "seq_no"))
plan("latest_batch", lambda t: latest_batch(t.batch_recon, P).select("rpt_grp_id", "batch_id", "seq_no", "created_timestamp"))
plan("latest_recon", lambda t: latest_recon(t.hit_recon, P).select("rpt_grp_id", "run_date", "seq_no", "created_timestamp"))
plan(
    "controls",
    lambda t: latest_batch(t.batch_recon, P).select("rpt_grp_id", "batch_id", *[gap(c).alias(f"{c}_diff") for c in EQUATIONS]),
)

# Snapshots and headline figures
plan("latest_batch_state", lambda t: latest_batch(t.batch_recon, P))
plan("latest_recon_state", lambda t: latest_recon(t.hit_recon, P))
plan("kpi_cards", lambda t: kpi.kpi_cards(t.batch_recon, P))
plan("rule_recon_totals", lambda t: kpi.rule_recon_totals(t.hit_recon, P))
for _which in ("expected", "matched", "missed"):
    plan(f"{_which}_rule_hits", lambda t, w=_which: kpi.hit_total(t.hit_recon, P, w))
plan("dashboard_summary", lambda t: kpi.dashboard_summary(t.batch_recon, t.hit_recon, P))
plan("batch_health", lambda t: kpi.batch_health(t.batch_recon, P))
plan("issues_by_type", lambda t: kpi.issues_by_type(t.batch_recon, P))
plan("report_group_health", lambda t: kpi.report_group_health(t.batch_recon, t.hit_recon, P))
plan("problem_batches", lambda t: batches.problem_batches(t.batch_recon, P))


def _filtered(t: Tables, f: filters.Filters) -> DataFrame:
    return filters.filtered_batches(t.batch_recon, P, f, batch_info=t.batch_info, hits=t.hits, journey=t.journey, config=t.group_config)


def _filtered_recon(t: Tables, f: filters.Filters) -> DataFrame:
    return filters.filtered_recon(t.hit_recon, f, config=t.group_config)


# The headline operators over filtered tables, each filter once.
BY_STATUS, BY_ISSUE = filters.Filters(batch_status="Generated"), filters.Filters(issue_type="DUPLICATE_TRANSFORMATION")
BY_STAGE, BY_COUNTRY = filters.Filters(stage="TRANSACTION_JOIN"), filters.Filters(country="ASIA")
BY_RULE, BY_GROUP = filters.Filters(rule_id="R7", source="TARGET"), filters.Filters(rpt_grp_id=105, batch_id="B199607")
plan("kpi_cards__status", lambda t: kpi.kpi_cards(_filtered(t, BY_STATUS), P))
plan("kpi_cards__group", lambda t: kpi.kpi_cards(_filtered(t, BY_GROUP), P))
plan("dashboard_summary__country", lambda t: kpi.dashboard_summary(_filtered(t, BY_COUNTRY), _filtered_recon(t, BY_COUNTRY), P))
plan("batch_health__rule", lambda t: kpi.batch_health(_filtered(t, BY_RULE), P))
plan("issues_by_type__stage", lambda t: kpi.issues_by_type(_filtered(t, BY_STAGE), P))
plan("report_group_health__country", lambda t: kpi.report_group_health(_filtered(t, BY_COUNTRY), _filtered_recon(t, BY_COUNTRY), P))
plan("problem_batches__issue", lambda t: batches.problem_batches(_filtered(t, BY_ISSUE), P))
plan("operations_trend", lambda t: kpi.operations_trend(t.batch_recon, P))
plan("report_group_batches", lambda t: batches.report_group_batches(t.batch_recon, P))
plan("batch_control_summary", lambda t: batches.batch_control_summary(t.batch_recon))
plan("recon_trend", lambda t: kpi.recon_trend(t.hit_recon, P))
plan("recon_by_group", lambda t: kpi.recon_by_group(t.hit_recon, P))
plan("recon_group_runs", lambda t: kpi.recon_group_runs(t.hit_recon, P))
plan("transformation_summary", lambda t: batches.transformation_summary(t.batch_recon, P))
plan("reportable_recon", lambda t: batches.reportable_recon(t.batch_recon, P))
plan("eligibility_recon", lambda t: batches.eligibility_recon(t.batch_recon, P))
plan("recon_issue_counts", lambda t: batches.recon_issue_counts(t.batch_recon, P))
plan("recon_issue_detail", lambda t: batches.recon_issue_detail(t.batch_recon, P))
plan("batch_health_table", lambda t: batches.batch_health_table(t.batch_recon, P))
plan("batch_full_detail", lambda t: batches.batch_full_detail(t.batch_recon))
plan("failures_by_batch", lambda t: batches.failures_by_batch(t.batch_recon, P))

# Control equations
for _name in EQUATIONS:
    plan(f"ctl_{_name}", lambda t, n=_name: batches.control(t.batch_recon, P, n))


def _hit_control(t: Tables, which: str) -> DataFrame:
    diff = rule_hit_gap() if which == "rule_hits" else rule_hit_publish_gap()
    return latest_recon(t.hit_recon, P).select("rpt_grp_id", "run_date", diff.alias("difference"), (diff == 0).alias("balanced"))


plan("ctl_rule_hits", lambda t: _hit_control(t, "rule_hits"))
plan("ctl_rule_hits_publish", lambda t: _hit_control(t, "publish"))

# Validation
V = validation
parts("val_batch_join_time", "summary status unmatched timing", lambda t: V.batch_join_time(t.batch_recon, t.batch_info, P))
parts("val_control_equations", "summary mismatches", lambda t: V.control_equations(t.batch_recon, P))
parts("val_future_reporting", "summary largest", lambda t: V.future_reporting(t.batch_recon, P))
parts("val_already_reported", "summary mismatches", lambda t: V.already_reported(t.batch_recon, t.journey, P))
parts("val_missing_attempt", "summary mismatches", lambda t: V.missing_attempt(t.batch_recon, t.journey, P))
parts("val_transformed_failed", "summary mismatches", lambda t: V.transformed_failed(t.batch_recon, t.journey, P))
parts("val_duplicates", "summary largest", lambda t: V.duplicates(t.batch_recon, P))
plan("val_rule_hit_linkage", lambda t: V.rule_hit_linkage(t.hits, t.batch_recon, P))
parts("val_exclusion_audit", "summary reasons", lambda t: V.exclusion_audit(t.audit, t.batch_recon, P))
parts("val_recon_grains", "summary groups", lambda t: V.recon_grains(t.hit_recon, P))
plan("disc_batch_status", lambda t: V.batch_status_values(t.batch_info, P))
parts(
    "val_recon_detail_populations", "log log_values analysis analysis_values unprocessed unprocessed_values",
    lambda t: V.recon_detail_populations(t.recon_log, t.recon_analysis, t.unprocessed, P),
)
parts("val_recon_detail_linkage", "summary samples", lambda t: V.recon_detail_linkage(t.hit_recon, t.recon_log, t.recon_analysis, P))
parts(
    "val_missed_hit_evidence", "summary samples",
    lambda t: V.missed_hit_evidence(t.hit_recon, t.recon_log, t.recon_analysis, t.unprocessed, P),
)
parts("val_report_generation", "summary compiler mismatches", lambda t: V.report_generation(t.batch_recon, t.journey, t.batch_info, P))
parts("val_rule_hit_recon", "summary rows", lambda t: V.rule_hit_recon(t.hit_recon, P))
parts("val_transformation_waterfall", "summary details", lambda t: V.transformation_waterfall(t.batch_recon, P))
parts("val_selection_balance", "summary top", lambda t: V.selection_balance(t.batch_recon, P))
parts("val_control_relationships", "summary exceptions", lambda t: V.control_relationships(t.batch_recon, P))
plan("json_row", lambda t: sinks.json_report({k: v for k, v in V.duplicates(t.batch_recon, P).items() if k == "summary"}))

# Bridges
plan("batch_bridge_candidates", lambda t: bridges.batch_bridge_candidates(t.batch_recon, t.hits, t.audit, P))
parts("journey_without_recon", "summary missing", lambda t: bridges.journey_without_recon(t.journey, t.batch_recon, P))
parts("bridge_by_group", "summary groups samples", lambda t: bridges.bridge_by_group(t.batch_recon, t.hits, t.audit, P))
parts("txn_bridge_candidates", "summary totals", lambda t: bridges.txn_bridge_candidates(t.batch_recon, t.journey, t.hits, P))
parts("missed_definition_candidates", "summary rows", lambda t: bridges.missed_definition_candidates(t.hit_recon, t.hits, P))
plan(
    "missed_definition_candidates__by_created",
    lambda t: bridges.missed_definition_candidates(t.hit_recon, t.hits, P, anchor="created_timestamp", null_safe=False)["rows"],
)
parts("locate_recon_detail", "summary samples", lambda t: bridges.locate_recon_detail(t.hit_recon, t.hits))

# Journey
plan("stage_status", lambda t: journey.stage_status(t.journey))
plan("failure_reasons", lambda t: journey.failure_reasons(t.journey))
plan("transformation_failures", lambda t: journey.transformation_failures(t.journey))
plan("failed_transactions", lambda t: journey.failed_transactions(t.journey))
plan("attempt_not_received", lambda t: journey.attempt_not_received(t.journey))
plan("join_problems", lambda t: journey.join_problems(t.journey))
plan("txn_journey", lambda t: journey.txn_journey(t.journey))
plan("txn_journey_global", lambda t: journey.txn_journey(t.journey))
plan("journey_profile", lambda t: journey.journey_profile(t.journey, P))
plan("journey_markers", lambda t: journey.journey_markers(t.journey))
plan("latest_stage", lambda t: snapshots.latest_stage(t.journey))
plan("txn_root_cause", lambda t: journey.txn_root_cause(t.journey, t.hits, t.audit))
plan("evidence_tabs", lambda t: journey.evidence_tabs(t.batch_recon, t.journey, t.hits, t.audit, P))

# Rule hits, weekly pack and page measures
plan("rule_hit_detail", lambda t: hits.rule_hit_detail(t.hits))
plan("exclusion_audit_detail", lambda t: hits.exclusion_audit_detail(t.audit))
plan("rule_breakdown", lambda t: hits.rule_breakdown(t.hits))
plan("exclusion_reasons", lambda t: hits.exclusion_reasons(t.hits, P))
plan("exclusion_audit_summary", lambda t: hits.exclusion_audit_summary(t.audit, P))
plan("is_reported_distribution", lambda t: hits.is_reported_distribution(t.hits))
plan("is_reported_vs_exclusion", lambda t: hits.is_reported_vs_exclusion(t.hits))
plan("cohort_balance", lambda t: hits.cohort_balance(t.hits, P))
plan("weekly_reporting_health", lambda t: hits.weekly_reporting_health(t.hits, P))
plan("open_backlog_aging", lambda t: hits.open_backlog_aging(t.hits, P))
plan("processing_exceptions", lambda t: batches.processing_exceptions(t.batch_recon, P))
plan("transformation_flow", lambda t: batches.transformation_flow(t.batch_recon, P))
plan("recon_issue_counts_raw", lambda t: batches.recon_issue_counts(t.batch_recon, P, raw=True))
plan("recon_issue_detail_raw", lambda t: batches.recon_issue_detail(t.batch_recon, P, raw=True))
plan("group_reporting_health", lambda t: hits.group_reporting_health(t.hits, P))
plan("group_backlog_health", lambda t: hits.group_backlog_health(t.hits, P))
plan("group_transformation_health", lambda t: batches.group_transformation_health(t.batch_recon, P))
plan("batch_health_weekly", lambda t: batches.batch_health_weekly(t.batch_recon, P))
plan("exception_breakdown", lambda t: batches.exception_breakdown(t.batch_recon, P))
plan("daily_reporting_trend", lambda t: hits.daily_reporting_trend(t.hits, P))
plan("open_value_by_currency", lambda t: metrics.open_value_by_currency(t.hits, P))
plan("age_bands", lambda t: hits.age_bands(t.hits, P))
plan("hit_disposition", lambda t: metrics.hit_disposition(t.hits, P))
plan("report_lag", lambda t: metrics.report_lag(t.hits, P))
plan("exclusion_defects", lambda t: metrics.exclusion_defects(t.hits, P, defect="Transaction Cancelled"))
plan("exclusion_daily_trend", lambda t: metrics.exclusion_daily_trend(t.hits, P, "Txn is already reported"))
plan("recon_table", lambda t: metrics.recon_table(t.hit_recon, P))
plan("group_breakdown", lambda t: metrics.group_breakdown(t.hits, P))
plan("open_hits_drill", lambda t: metrics.open_hits_drill(t.hits, P))
plan("open_hits_drill__page", lambda t: metrics.open_hits_drill(t.hits, P, band="30_plus", page_size=100, source="TARGET"))
plan("tie_out", lambda t: metrics.tie_out(t.hits, P))


def _export(t: Tables) -> DataFrame:
    path = sinks.shared_folder(t.spark, "open-hits")
    rows = metrics.open_hits_drill(t.hits, P)
    sinks.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).csv(path, header=True)


plan("export_open_hits", _export)
plan("kpi_groups", lambda t: kpi.kpi_groups(t.batch_recon, t.hit_recon, t.batch_info, P))
plan("report_group_health_full", lambda t: kpi.report_group_health_full(t.batch_recon, t.hit_recon, t.batch_info, t.group_config, P))
plan("batch_control_room", lambda t: batches.batch_control_room(t.batch_recon, t.batch_info, t.group_config))
plan("batch_investigation_queue", lambda t: batches.batch_investigation_queue(t.batch_recon, t.batch_info, P))


def _health(t: Tables) -> DataFrame:
    runs = kpi.with_batch_info(latest_batch(t.batch_recon, P), t.batch_info)
    return runs.select("rpt_grp_id", "batch_id", health_five_level().alias("health"))


plan("health_five_level", _health)

# Transformer
T = transform
plan("select_rule_hits", lambda t: T.select_rule_hits(t.hits).select(*HIT_KEY))
plan("drop_sml", lambda t: T.drop_sml(t.hits).select(*HIT_KEY))
plan("recon_keys", lambda t: T.recon_keys(t.hits, t.group_config))
plan("key_excluded", lambda t: T.key_excluded(t.hits, t.group_config))
parts(
    "missing_attempts", "kept counts evidence",
    lambda t: {k: v.select(*HIT_KEY) if k == "kept" else v for k, v in T.missing_attempts(t.hits, t.attempts, t.group_config).items()},
)
parts(
    "already_reported", "kept evidence",
    lambda t: {
        k: v.select(*HIT_KEY) if k == "kept" else v
        for k, v in T.already_reported(T.select_rule_hits(t.hits), t.hits, t.group_config).items()
    },
)
plan("soft_dedup", lambda t: T.soft_dedup(T.select_rule_hits(t.hits), t.group_config).select(*HIT_KEY))
plan("soft_dedup__dropped", lambda t: T.soft_dedup_dropped(T.select_rule_hits(t.hits), t.group_config))
plan("future_reporting_lookback", lambda t: T.future_reporting(t.hits, T.batch_windows(t.batch_info), "lookback"))
plan("future_reporting_period", lambda t: T.future_reporting(t.hits, T.batch_windows(t.batch_info), "period"))
plan(
    "build_batch_reconciliation",
    lambda t: T.build_batch_reconciliation(t.hits, t.attempts, t.group_config, T.batch_windows(t.batch_info)),
)


def _whole_rows(t: Tables) -> DataFrame:
    """All five tables, the windows twice, come from the same lines."""
    t = t.kept()
    windows = T.batch_windows(t.batch_info)
    return T.batch_reconciliation_rows(t.hits, t.attempts, t.group_config, windows, t.journey, t.batch_recon, datetime(2002, 1, 1))


plan("build_batch_reconciliation__row", _whole_rows)
plan(
    "build_batch_reconciliation__controls",
    lambda t: _whole_rows(t).select("rpt_grp_id", "batch_id", "seq_no", *[gap(c).alias(f"{c}_diff") for c in EQUATIONS]),
)


def _assigned(t: Tables) -> DataFrame:
    label = F.concat(F.lit("E"), F.date_format("transaction_date", "yyyyMM"))
    return T.assign_batch(t.hits, T.select_rule_hits(t.hits), label, datetime(2002, 1, 1)).select(*schema("rule_hit").fieldNames())


plan("assign_batch", _assigned)
plan(
    "upsert_latest",
    lambda t: snapshots.upsert_latest(t.batch_info.filter("seq_no = 1"), t.batch_info, ("rpt_grp_id", "batch_id"), ("seq_no",)),
)
plan(
    "expected_matched_missed",
    lambda t: T.expected_matched_missed(t.hits, t.hits.filter("is_reported"), ("external_txn_key", "rule_id")),
)

# Cases
plan("case_records", lambda t: cases.flat_case_records(t.cases_flat))
plan("grade_cases", lambda t: cases.grade_cases(cases.case_records(t.cases_flat)))
plan("risk_indicators", lambda t: cases.risk_indicators(cases.case_records(t.cases_flat)))


def _graded_with_documents(t: Tables) -> DataFrame:
    """Cases that sent a document: those over the agent channels of high priority."""
    graded = cases.grade_cases(cases.case_records(t.cases_flat))
    sent = t.cases_flat.filter("channel IN ('1-URGENT', '2-HIGH')").select(
        "mtcn", F.when(F.col("channel") == "1-URGENT", F.lit("unknown")).alias("other")
    )
    docs = graded.join(sent, "mtcn").withColumn("prior_grade", F.coalesce("other", "grade")).drop("other")
    return cases.regrade_with_document(docs)


plan("regrade_with_document", lambda t: _graded_with_documents(t))
plan(
    "final_grade",
    lambda t: cases.final_grade(cases.grade_cases(cases.case_records(t.cases_flat)), _graded_with_documents(t)),
)


def _uploads(t: Tables) -> DataFrame:
    """Documents and pages as uploads with names and content types."""
    docs = t.base("documents").selectExpr(
        "concat('d', doc_id) AS upload_id",
        "concat('Report_', source, ' (', lang, ').', CASE lang WHEN 'de' THEN 'PDF' WHEN 'fr' THEN 'jpg' WHEN 'es' THEN 'scan' ELSE 'txt' END) AS filename",
        "CASE lang WHEN 'es' THEN 'image/tiff' WHEN 'en' THEN 'text/plain' END AS content_type", "text",
    )
    pages = t.base("pages").selectExpr("concat('p', page_id) AS upload_id", "url AS filename", "'text/html' AS content_type", "html AS text")
    return docs.unionByName(pages)


plan("route_documents", lambda t: cases.route_documents(_uploads(t)))


def _answers(t: Tables) -> DataFrame:
    """Model answers around case data: fenced, talkative, cut off or with a wrong label."""
    return t.cases_flat.selectExpr(
        "mtcn",
        "concat(CASE channel WHEN '1-URGENT' THEN '```json\\n' WHEN '2-HIGH' THEN 'Here it is: ' ELSE '' END, "
        "'{\"grade\": \"', CASE WHEN receiver_country = 'ASIA' THEN 'SEVERE' ELSE 'HIGH' END, "
        "'\", \"recommendation\": \"', CASE WHEN receiver_country = 'EUROPE' THEN 'WAIT' ELSE 'ESCALATE' END, "
        "'\", \"confidence\": 0.5, \"rationale\": \"', sender_name, "
        "'\", \"risk_indicators\": [{\"indicator\": \"a\", \"severity\": \"', "
        "CASE WHEN receiver_country = 'AFRICA' THEN 'awful' ELSE 'low' END, '\", \"evidence\": \"b\"}]', "
        "CASE WHEN channel = '5-LOW' THEN '' ELSE '}' END, CASE channel WHEN '1-URGENT' THEN '\\n```' ELSE '' END) AS text",
    )


def _parsed(t: Tables) -> dict[str, DataFrame]:
    out = cases.parse_model_outputs(_answers(t))
    good = out["good"].select(
        "mtcn", "grade", "recommendation", "confidence", "rationale", F.get("risk_indicators", F.lit(0))["severity"].alias("severity")
    )
    return {"summary": good, "quarantine": out["quarantine"].select("mtcn", "reason")}


parts("parse_model_outputs", "summary quarantine", _parsed)


def _document_answers(t: Tables) -> DataFrame:
    """Answers about documents, most of which lack one field or one field of a finding."""
    finding = (
        "named_struct('finding', CASE channel WHEN '3-MEDIUM' THEN NULL ELSE 'seal' END, "
        "'severity', CASE channel WHEN '5-LOW' THEN 'awful' ELSE 'high' END, 'evidence', receiver_country)"
    )
    fields = (
        "'detected_language', CASE channel WHEN '2-HIGH' THEN NULL ELSE 'de' END, 'document_summary', sender_name, "
        f"'document_findings', array({finding}), 'grade', 'LOW', 'recommendation', 'APPROVE', 'confidence', 0.75D, "
        "'grade_changed', CASE WHEN channel = '4-NOT SPECIFIED' THEN NULL ELSE false END, 'change_reason', 'none', 'rationale', 'fits'"
    )
    return t.cases_flat.selectExpr("mtcn", f"concat('So: ', to_json(named_struct({fields}))) AS text")


def _parsed_documents(t: Tables) -> dict[str, DataFrame]:
    out = cases.parse_model_outputs(_document_answers(t), answer=cases.DOCUMENT_ANSWER)
    good = out["good"].select("mtcn", "detected_language", "document_summary", "grade", "confidence", "grade_changed")
    return {"documents": good, "documents_quarantine": out["quarantine"].select("mtcn", "reason")}


parts("parse_model_outputs", "documents documents_quarantine", _parsed_documents)


def _decisions(t: Tables) -> DataFrame:
    """Analyst decisions read off the event stream."""
    return t.case_events.selectExpr(
        "split(case_id, '-')[0] AS mtcn", "CASE to_status WHEN 'complete' THEN 'APPROVED' WHEN 'error' THEN 'DENIED' ELSE 'LATER' END AS action",
        "CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END AS grade", "ts AS decided_at", "event_id AS decision_id",
    )


plan("decisions", lambda t: cases.latest_decisions(_decisions(t)))
plan("threshold_structuring", lambda t: cases.threshold_structuring(t.transfers, 250000, 50000))

# Lifecycle
L = lifecycle
plan("case_status_view", lambda t: L.case_status_view(t.cases, t.stage_results))
plan("case_summary_view", lambda t: L.case_summary_view(t.cases, t.stage_results))
plan("list_cases", lambda t: L.list_cases(t.cases))
plan("list_cases__next", lambda t: L.list_cases(t.cases, cursor=(datetime(2024, 1, 10), "5-5"), limit=20))
plan("list_cases__owner", lambda t: L.list_cases(t.cases, owner="u7", limit=10))
plan("list_cases__cursor", lambda t: L.next_cursor(L.list_cases(t.cases)))
plan("dedupe_submissions", lambda t: L.dedupe_submissions(t.submissions))
plan("claim_cases", lambda t: L.claim_cases(t.claims))
plan("idempotent_stages", lambda t: L.idempotent_stages(t.stage_results))
plan("guarded_transitions", lambda t: L.guarded_transitions(t.case_events))
plan("reap_stuck", lambda t: L.reap_stuck(t.cases, AS_OF))
plan("active_case_cap", lambda t: L.active_case_cap(t.cases))
plan("lifecycle_metrics", lambda t: L.lifecycle_metrics(t.case_events, submissions=t.submissions))
plan("stage_durations", lambda t: L.stage_durations(t.stage_results))
plan("poll_rate", lambda t: L.poll_rate(t.case_events))
plan("silent_sessions", lambda t: L.silent_sessions(t.case_events, AS_OF))
plan("assemble_stream", lambda t: L.assemble_stream(t.stream_entries))
plan("resume_from", lambda t: L.resume_from(t.stream_entries, last_id=3))
plan("expire_streams", lambda t: L.expire_streams(t.stream_entries, STREAM_AS_OF))
plan("open_sessions", lambda t: L.open_sessions(t.stream_entries))


# Streaming forms: each runs its stream over all events and returns the table it leaves.
def _stream(t: Tables, name: str, build: Callable[[DataFrame], DataFrame | streams.Parts], keys: tuple[str, ...], mode: str = "update") -> DataFrame:
    folder = sinks.shared_folder(t.spark, name)
    stream = build(streams.read_events(streams.stream_session(t.spark), t.folder))
    streams.run(stream, folder, keys, mode)
    return streams.table(t.spark, folder, keys, stream)


# No registered stream may lose a row, however its files are cut: the rows lie within this of the newest.
SPAN = "400 days"
plan("stream_lifecycle_metrics", lambda t: _stream(t, "metrics", lambda e: streams.metrics(case_events(e), delay=SPAN), ("window_start",)))


def _earliest(t: Tables, name: str, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...]) -> DataFrame:
    return streams.first_of(_stream(t, name, build, (*keys, "window_start")), keys)


plan("stream_dedupe_submissions", lambda t: _earliest(t, "dedupe", lambda e: streams.dedupe_submissions(submissions(e), SPAN), ("idempotency_key",)))
plan(
    "stream_idempotent_stages",
    lambda t: _earliest(t, "stages", lambda e: streams.idempotent_stages(stage_results(case_events(e)), SPAN), ("case_id", "stage")),
)
plan(
    "stream_guarded_transitions",
    lambda t: _stream(t, "guarded", lambda e: streams.guarded_transitions(case_events(e), SPAN), ("case_id", "bucket")).select(
        "case_id", "status", "accepted", "dropped"
    ),
)


def _bursts(t: Tables) -> DataFrame:
    folder = sinks.shared_folder(t.spark, "sessions")
    beside = streams.stream_session(t.spark)
    streams.run(streams.sessions(case_events(streams.read_events(beside, t.folder)), delay=SPAN), folder, ("case_id", "started_at"), "append")
    return streams.all_bursts(beside, folder)


plan("stream_sessions", _bursts)
plan("stream_reap_stuck", lambda t: _stream(t, "reap", lambda e: streams.reap_stuck(case_events(e), delay=SPAN), ("case_id", "bucket")))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, build=build: build(Tables(spark, folder))) for name, build in PLANS.items()}
