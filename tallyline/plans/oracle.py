"""DuckDB statements that give the same rows as the registered plans."""

from __future__ import annotations

from tallyline.plans.oracle_tables import with_tables

START, AFTER, LAST = "DATE '1996-06-01'", "DATE '1996-10-01'", "DATE '1996-09-30'"
INSIDE = f"created_timestamp >= {START} AND created_timestamp < {AFTER}"
TXN_INSIDE = f"transaction_date >= {START} AND transaction_date < {AFTER}"
OPEN = f"(exclusion_reason_id IS NULL AND (reporting_timestamp IS NULL OR reporting_timestamp >= {AFTER}))"
DONE = f"(exclusion_reason_id IS NULL AND reporting_timestamp < {AFTER})"
AGE = f"date_diff('day', transaction_date::DATE, {LAST})"


def z(c: str) -> str:
    return f"coalesce({c}, 0)"


def tot(c: str, name: str | None = None) -> str:
    return f"sum({z(c)})::BIGINT AS {name or c}"


def raw(c: str, name: str | None = None) -> str:
    return f"sum({c})::BIGINT AS {name or c}"


def sure(c: str, name: str) -> str:
    return f"coalesce(sum({c}), 0)::BIGINT AS {name}"


def cnt(cond: str, name: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


def dst(col: str, cond: str, name: str) -> str:
    return f"count(DISTINCT {col}) FILTER ({cond}) AS {name}"


def pct(a: str, b: str) -> str:
    """Percentage rounded half up to two digits in whole numbers."""
    return f"((20000 * ({a})::HUGEINT + ({b})) // nullif(2 * ({b})::HUGEINT, 0))::DOUBLE / 100"


NEWEST = "ORDER BY seq_no DESC, modified_timestamp DESC NULLS LAST, created_timestamp DESC NULLS LAST"

# Left side of each control and its right side.
SIDES = {
    "reportable": ("expected_reportable_txn", ["actual_reportable_txn"]),
    "eligibility": ("expected_activity_eligible_for_transformation", ["actual_activity_eligible_for_transformation"]),
    "lookback": ("lookback_txn", ["lookback_actual_txn", "lookback_future_reporting_txn"]),
    "reporting_period": ("reporting_period_txn", ["reporting_period_actual_txn", "reporting_period_future_reporting_txn"]),
    "activity": ("activity_selected", ["lookback_txn", "reporting_period_txn", "activity_simulated"]),
    "transformation": ("actual_activity_eligible_for_transformation", ["activity_transformed", "activity_transformation_failed"]),
    "transformation_with_dup": (
        "actual_activity_eligible_for_transformation",
        ["activity_transformed", "activity_transformation_failed", "duplicate_transformation"],
    ),
    "expected_vs_selected": ("expected_reportable_txn", ["activity_selected"]),
    "selection": (
        "txn_selected",
        ["excluded_txn", "txn_missing_attempt_count", "already_reported_count", "expected_reportable_txn"],
    ),
}
GAPS = ", ".join(f"{z(a)} - ({' + '.join(z(x) for x in b)}) AS g_{n}" for n, (a, b) in SIDES.items())
RECON = "(g_reportable <> 0 OR g_eligibility <> 0)"
FAIL = "coalesce(activity_transformation_failed, 0) > 0"
ISSUE = f"({RECON} OR {FAIL})"
IMBALANCED = "(g_lookback <> 0 OR g_reporting_period <> 0 OR g_activity <> 0 OR g_transformation <> 0)"


def health(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {RECON} THEN '{a}' WHEN {FAIL} THEN '{b}' ELSE '{c}' END"


LEVEL = f"""CASE WHEN coalesce(batch_status, '') = 'Failed' OR coalesce(report_status, '') = 'FAILED'
    OR coalesce(compiler_status, '') IN ('Data Selection Failed', 'Data Transformation Failed', 'Report Generation Failed') THEN 'Failed'
    WHEN coalesce(batch_status, '') = 'In Progress' OR coalesce(compiler_status, '') IN
        ('Data Selection Completed', 'Data Transformation Started', 'Data Transformation Completed', 'Report Generation Started') THEN 'In Progress'
    WHEN {RECON} OR {IMBALANCED} THEN 'Critical'
    WHEN {FAIL} OR coalesce(duplicate_transformation, 0) > 0 OR coalesce(txn_missing_attempt_count, 0) > 0 OR batch_status IS NULL THEN 'Warning'
    ELSE 'Healthy' END"""

SRC, TGT, MIS, PUB = (
    "distinct_rule_hits_count_source", "distinct_rule_hits_count_target", "missed_rule_hits_count_target",
    "rule_hit_publish_count_source",
)

DEFINITIONS = {
    "missed_is_reported_false": "exclusion_reason_id IS NULL AND is_reported = false",
    "missed_is_reported_not_true": "exclusion_reason_id IS NULL AND is_reported IS NOT TRUE",
    "missed_reporting_timestamp_null": "exclusion_reason_id IS NULL AND reporting_timestamp IS NULL",
    "missed_reported_batch_null": "exclusion_reason_id IS NULL AND reported_batch_id IS NULL",
    "matched_true_nonexcluded": "exclusion_reason_id IS NULL AND is_reported",
    "matched_true_all": "is_reported",
    "matched_timestamp_present": "reporting_timestamp IS NOT NULL",
}


def definitions(runs: str) -> str:
    keys = ", ".join(f"count(DISTINCT (external_txn_key, rule_id)) FILTER ({c}) AS {n}" for n, c in DEFINITIONS.items())
    return f"""SELECT rpt_grp_id, run_date, seq_no, count(*) AS rule_hit_rows,
        count(DISTINCT (external_txn_key, rule_id)) AS distinct_rule_hit_keys, {keys}
        FROM {runs} JOIN hits USING (rpt_grp_id)
        WHERE transaction_date BETWEEN data_selection_start_date AND data_selection_end_date GROUP BY ALL"""


def definition_rows(runs: str, found: str, empty: dict[str, int]) -> str:
    cols = ", ".join(f"coalesce({n}, {empty.get(n, 0)}) AS {n}" for n in ("rule_hit_rows", "distinct_rule_hit_keys", *DEFINITIONS))
    var = ", ".join(
        f"coalesce({n}, {empty.get(n, 0)}) - coalesce({MIS if n.startswith('missed') else TGT}, 0) AS variance_{n}" for n in DEFINITIONS
    )
    return f"""SELECT r.rpt_grp_id, r.run_date, r.seq_no, r.rpt_grp_name, r.created_timestamp, r.data_selection_start_date,
        r.data_selection_end_date, {z(SRC)} AS reconciliation_expected, {z(TGT)} AS reconciliation_matched,
        {z(MIS)} AS reconciliation_missed, {cols}, {var}
        FROM {runs} r LEFT JOIN {found} USING (rpt_grp_id, run_date, seq_no)"""


STRATEGY_PART = """CASE reconciliation_strategy_metadata WHEN 'TRANSACTION_PER_RULE' THEN rule_id
    WHEN 'INTRA_COUNTRY' THEN CASE rule_id WHEN inbound_rule_id THEN 'IN' WHEN outbound_rule_id THEN 'OUT' END END"""

# Shared steps on top of the derived tables.
STEPS: dict[str, str] = {
    "lb": f"SELECT * FROM batch_recon WHERE {INSIDE} QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, batch_id {NEWEST}) = 1",
    "lbx": f"SELECT *, {GAPS} FROM lb",
    "any_lb": f"SELECT *, {GAPS} FROM batch_recon QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, batch_id {NEWEST}) = 1",
    "info": """SELECT * EXCLUDE (created_timestamp), created_timestamp AS batch_info_created_timestamp, true AS has_info
        FROM batch_info""",
    "lbi": "SELECT * FROM lbx LEFT JOIN info USING (rpt_grp_id, batch_id, seq_no)",
    "any_lbi": "SELECT * FROM any_lb LEFT JOIN info USING (rpt_grp_id, batch_id, seq_no)",
    "lr": f"""SELECT * FROM hit_recon WHERE run_date BETWEEN 19960601 AND 19960930
        QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, run_date {NEWEST}) = 1""",
    "lr_made": f"""SELECT * FROM hit_recon WHERE {INSIDE}
        QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, run_date {NEWEST}) = 1""",
    "any_lr": f"SELECT * FROM hit_recon QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, run_date {NEWEST}) = 1",
    "runs": f"SELECT DISTINCT rpt_grp_id, batch_id FROM batch_recon WHERE {INSIDE} AND batch_id IS NOT NULL",
    "kpi": f"""SELECT count(DISTINCT batch_id) AS batches_run, count(DISTINCT rpt_grp_id) AS report_groups_run,
        {dst('batch_id', ISSUE, 'batches_with_issues')}, {tot('activity_transformation_failed', 'transformation_failures')},
        {dst('batch_id', RECON, 'reconciliation_issue_batches')} FROM lbx""",
    "hit_sums": f"SELECT {tot(SRC, 'expected_rule_hits')}, {tot(TGT, 'matched_rule_hits')}, {tot(MIS, 'missed_rule_hits')} FROM lr",
    "ls": """SELECT * FROM journey QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, batch_id, identifier, stage
        ORDER BY modified_timestamp DESC NULLS LAST, created_timestamp DESC NULLS LAST) = 1""",
    "cohort_hits": f"SELECT * FROM hits WHERE {TXN_INSIDE}",
    "backlog": f"SELECT *, {AGE} AS age FROM hits WHERE transaction_date < {AFTER} AND {OPEN}",
    "defs": definitions("lr"),
    "defs_made": definitions("lr_made"),
    "def_rows": definition_rows("lr", "defs", {}),
    "journey_cmp": """SELECT b.*, coalesce(n, 0) AS journey_rows, coalesce(already, 0) AS already_reported_rows,
            coalesce(miss, 0) AS missing_attempt_rows, coalesce(good, 0) AS transformed_rows, coalesce(bad, 0) AS failed_rows
        FROM lb b LEFT JOIN (
            SELECT rpt_grp_id, batch_id, count(*) AS n,
                   count(*) FILTER (stage = 'FILTRATION' AND status = 'EXCLUDED' AND comments LIKE 'EXCLUDED_BECAUSE_ALREADY_REPORTED(%)') AS already,
                   count(*) FILTER (stage = 'TRANSACTION_JOIN' AND status = 'ERROR' AND comments = 'ATTEMPT_NOT_RECEIVED') AS miss,
                   count(*) FILTER (stage = 'TRANSFORMATION' AND status = 'SUCCESS') AS good,
                   count(*) FILTER (stage = 'TRANSFORMATION' AND status = 'FAILURE' AND comments = 'TRANSFORMATION_SKIPPED') AS bad
            FROM journey GROUP BY ALL) USING (rpt_grp_id, batch_id)""",
    "linkage": f"""SELECT rpt_grp_id, run_date, seq_no, rpt_grp_name, {SRC} AS expected_rule_hits, {TGT} AS matched_rule_hits,
            {MIS} AS missed_rule_hits, coalesce(log_rows, 0) AS log_rows, coalesce(lt, 0) AS log_distinct_transactions,
            coalesce(lu, 0) AS log_distinct_rules, coalesce(lp, 0) AS log_processed_rows, coalesce(ln, 0) AS log_unprocessed_rows,
            coalesce(lrep, 0) AS log_reported_rows, coalesce(lnr, 0) AS log_not_reported_rows, coalesce(an, 0) AS analysis_rows,
            coalesce(at_, 0) AS analysis_distinct_transactions, coalesce(ar, 0) AS analysis_distinct_rules
        FROM hit_recon
        LEFT JOIN (SELECT rpt_grp_id, run_date, seq_no, count(*) AS log_rows, count(DISTINCT external_txn_key) AS lt,
            count(DISTINCT rule_id) AS lu, {cnt('is_processed', 'lp')}, {cnt('NOT is_processed', 'ln')},
            {cnt('is_reported', 'lrep')}, {cnt('NOT is_reported', 'lnr')} FROM recon_log GROUP BY ALL) USING (rpt_grp_id, run_date, seq_no)
        LEFT JOIN (SELECT rpt_grp_id, run_date, seq_no, count(*) AS an, count(DISTINCT txn_sur_key) AS at_,
            count(DISTINCT rule_id) AS ar FROM recon_analysis GROUP BY ALL) USING (rpt_grp_id, run_date, seq_no)
        WHERE {INSIDE}""",
    "missed_cmp": f"""SELECT rpt_grp_id, run_date, seq_no, rpt_grp_name, {SRC} AS expected_rule_hits, {TGT} AS matched_rule_hits,
            {MIS} AS missed_rule_hits, coalesce(l1, 0) AS log_rows, coalesce(l2, 0) AS log_not_processed,
            coalesce(l3, 0) AS log_not_reported, coalesce(l4, 0) AS log_not_processed_not_reported, coalesce(l5, 0) AS log_excluded,
            coalesce(l6, 0) AS log_future_reporting, coalesce(an, 0) AS analysis_rows, coalesce(u1, 0) AS unprocessed_rows,
            coalesce(u2, 0) AS unprocessed_not_reported, coalesce(u3, 0) AS unprocessed_excluded
        FROM hit_recon
        LEFT JOIN (SELECT rpt_grp_id, run_date, seq_no, count(*) AS l1, {cnt('NOT is_processed', 'l2')}, {cnt('NOT is_reported', 'l3')},
            {cnt('NOT is_processed AND NOT is_reported', 'l4')}, count(exclusion_reason_id) AS l5, count(future_reporting_date) AS l6
            FROM recon_log GROUP BY ALL) USING (rpt_grp_id, run_date, seq_no)
        LEFT JOIN (SELECT rpt_grp_id, run_date, seq_no, count(*) AS an FROM recon_analysis GROUP BY ALL) USING (rpt_grp_id, run_date, seq_no)
        LEFT JOIN (SELECT rpt_grp_id, count(*) AS u1, {cnt('NOT is_reported', 'u2')}, count(exclusion_reason_id) AS u3
            FROM unprocessed WHERE {INSIDE} GROUP BY ALL) USING (rpt_grp_id)
        WHERE {INSIDE} AND {MIS} > 0""",
    "generation": """SELECT *, coalesce(g, 0) AS generated_txn, coalesce(actual_reportable_txn, 0) AS actual,
            coalesce(g, 0) - coalesce(actual_reportable_txn, 0) AS difference
        FROM lbi LEFT JOIN (SELECT rpt_grp_id, batch_id, count(DISTINCT identifier) AS g FROM journey
            WHERE stage = 'REPORT_GENERATION' AND status = 'GENERATED' GROUP BY ALL) USING (rpt_grp_id, batch_id)""",
    "hit_audit_batches": """SELECT b.rpt_grp_id, b.rpt_grp_name, b.batch_id, coalesce(h, 0) AS rule_hit_rows,
            coalesce(hr, 0) AS distinct_rules, coalesce(hm, 0) AS distinct_mtcns, coalesce(a, 0) AS exclusion_rows
        FROM (SELECT DISTINCT rpt_grp_id, rpt_grp_name, batch_id FROM batch_recon JOIN runs USING (rpt_grp_id, batch_id)) b
        LEFT JOIN (SELECT rpt_grp_id, efile_batch_id AS batch_id, count(*) AS h, count(DISTINCT rule_id) AS hr,
            count(DISTINCT mtcn) AS hm FROM hits GROUP BY ALL) USING (rpt_grp_id, batch_id)
        LEFT JOIN (SELECT rpt_grp_id, processing_batch_id AS batch_id, count(*) AS a FROM audit GROUP BY ALL) USING (rpt_grp_id, batch_id)""",
    "jt": """SELECT DISTINCT rpt_grp_id, batch_id, identifier, mtcn, json_extract_string(txn_metadata, '$.txn_sur_key') AS sur
        FROM journey SEMI JOIN runs USING (rpt_grp_id, batch_id)""",
    "hk": """SELECT rpt_grp_id, efile_batch_id AS batch_id, external_txn_key AS ext, mtcn FROM hits
        JOIN runs ON runs.rpt_grp_id = hits.rpt_grp_id AND runs.batch_id = hits.efile_batch_id""".replace(
        "SELECT rpt_grp_id", "SELECT hits.rpt_grp_id"
    ),
    "keyed": f"""SELECT h.*, external_txn_key::VARCHAR AS key_txn, {STRATEGY_PART} AS key_part
        FROM hits h LEFT JOIN (SELECT * EXCLUDE rpt_grp_name FROM group_config) USING (rpt_grp_id)""",
    "gone": """SELECT rpt_grp_id, key_txn, key_part, count(*) AS row_count FROM keyed
        LEFT JOIN attempts USING (attempt_id) GROUP BY ALL HAVING count(txn_sur_key) = 0""",
    "candidates": "SELECT * FROM keyed WHERE efile_batch_id IS NULL AND exclusion_reason_id IS NULL",
    "reported_n": "SELECT rpt_grp_id, key_txn, key_part, count(*) AS n_rep FROM keyed WHERE is_reported GROUP BY ALL",
    "windows": """SELECT rpt_grp_id, batch_id, arg_max(txn_lookback_start_timestamp, seq_no) AS w0,
        arg_max(txn_start_timestamp, seq_no) AS w1, arg_max(txn_end_timestamp, seq_no) AS w2 FROM batch_info GROUP BY ALL""",
    "pool": """SELECT w.batch_id AS run, w0, w1, w2, keyed.* EXCLUDE batch_id, txn_sur_key,
            exclusion_reason_id IS NULL AND NOT coalesce(contains(galactic_id, 'SML'), false)
                AND NOT coalesce(contains(mtcn, 'SML'), false) AS live,
            coalesce(n_rep, 0) > coalesce(is_reported, false)::INT AS other_reported
        FROM keyed LEFT JOIN reported_n r ON r.rpt_grp_id = keyed.rpt_grp_id AND r.key_txn = keyed.key_txn
            AND r.key_part IS NOT DISTINCT FROM keyed.key_part JOIN windows w ON w.rpt_grp_id = keyed.rpt_grp_id AND transaction_date BETWEEN w0 AND w2
        LEFT JOIN attempts USING (attempt_id) WHERE efile_batch_id IS NULL""",
    "pool_keys": """SELECT rpt_grp_id, run, key_txn, key_part, bool_and(exclusion_reason_id IS NOT NULL) AS all_ex,
            count(*) FILTER (live) AS n_live, count(*) FILTER (live AND NOT other_reported) AS n_left, count(txn_sur_key) FILTER (live) = 0 AS no_attempt,
            arg_max({'t': transaction_date, 'c': created_timestamp, 'r': reporting_timestamp, 'w0': w0, 'w1': w1, 'w2': w2, 'a': txn_sur_key},
                (attempt_id, rule_id, bucket_id)) FILTER (live AND NOT other_reported) AS x
        FROM pool GROUP BY ALL""",
    "pool_state": """SELECT k.*, n_left = 0 AS known, n_live > 0 AND NOT no_attempt AND n_left > 0 AS kept,
            x.c::DATE > x.r::DATE AND x.r >= x.w0 AND x.r < x.w1 AS f_look,
            x.c::DATE > x.r::DATE AND x.r >= x.w1 AND x.r <= x.w2 AS f_per
        FROM pool_keys k""",
    "graded": """SELECT *, [x FOR x IN list_transform(string_split(coalesce(flags, ''), ','), lambda f: trim(f)) IF x <> ''] AS fl
        FROM cases_flat""",
    "grades": """SELECT *, CASE WHEN gsi_match_score >= 0.75 OR flags ILIKE '%threshold%' OR flags ILIKE '%structur%' THEN 'HIGH'
            WHEN gsi_match_score < 0.7 AND (flags ILIKE '%consistent%' OR flags ILIKE '%long-standing%' OR flags ILIKE '%legitimate%') THEN 'LOW'
            WHEN gsi_match_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM graded""",
    "first_results": """SELECT case_id, stage, arg_min(output, (completed_at, event_id)) AS output, min(completed_at) AS completed_at
        FROM stage_results GROUP BY ALL""",
    "stream_ends": """SELECT session_id, min(entry_id) AS end_id, arg_min(type, entry_id) AS status, arg_min(ts, entry_id) AS ended_at
        FROM stream_entries WHERE type <> 'chunk' GROUP BY ALL""",
    "folded": """SELECT case_id, count(*) AS events, list_reduce(
            [{'s': 'queued', 'was': NULL::VARCHAR, 'n': 0, 't': NULL::TIMESTAMP}] ||
                list({'s': to_status, 'was': NULL::VARCHAR, 'n': 0, 't': ts} ORDER BY ts, event_id),
            lambda a, b: CASE
                WHEN a.s IN ('complete', 'error') THEN a
                WHEN b.s = 'error' THEN {'s': 'error', 'was': a.s, 'n': a.n + 1, 't': b.t}
                WHEN (a.s, b.s) IN (('queued', 'retrieving'), ('retrieving', 'analyzing'), ('analyzing', 'doc_analysis'), ('doc_analysis', 'complete'))
                    THEN {'s': b.s, 'was': a.was, 'n': a.n + 1, 't': b.t}
                ELSE a END) AS f
        FROM case_events GROUP BY ALL""",
}

SQL: dict[str, str] = {}

# Shared blocks
_DAYS = "(SELECT DISTINCT o_orderdate::DATE AS as_of FROM orders)"
SQL["period"] = f"""SELECT as_of, (as_of - (isodow(as_of) + 6)::INT) AS start_date, (as_of - isodow(as_of)::INT) AS end_date FROM {_DAYS}"""
SQL["period_prev_month"] = f"""SELECT as_of, (date_trunc('month', as_of) - INTERVAL 1 MONTH)::DATE AS start_date,
    (date_trunc('month', as_of)::DATE - 1) AS end_date FROM {_DAYS}"""
SQL["opt"] = "SELECT rpt_grp_id, batch_id, seq_no FROM batch_recon"
SQL["latest_batch"] = "SELECT rpt_grp_id, batch_id, seq_no, created_timestamp FROM lb"
SQL["latest_recon"] = "SELECT rpt_grp_id, run_date, seq_no, created_timestamp FROM lr"
SQL["controls"] = f"SELECT rpt_grp_id, batch_id, {', '.join(f'g_{n} AS {n}_diff' for n in SIDES)} FROM lbx"
for _n, _c in (("in_period", TXN_INSIDE), ("is_open", OPEN), ("is_reported_asof", DONE)):
    SQL[_n] = f"SELECT rpt_grp_id, bucket_id, rule_id, attempt_id FROM hits WHERE {_c}"

# Snapshots and headline figures
SQL["latest_batch_state"] = "SELECT * FROM lb"
SQL["latest_recon_state"] = "SELECT * FROM lr"
SQL["kpi_cards"] = "SELECT * FROM kpi"
SQL["rule_recon_totals"] = f"SELECT *, {pct('matched_rule_hits', 'expected_rule_hits')} AS match_rate_pct FROM hit_sums"
for _w in ("expected", "matched", "missed"):
    SQL[f"{_w}_rule_hits"] = f"SELECT {_w}_rule_hits FROM hit_sums"
SQL["dashboard_summary"] = "SELECT * FROM kpi, hit_sums"
SQL["batch_health"] = f"SELECT {health('CRITICAL', 'NEEDS_ATTENTION', 'HEALTHY')} AS health_status, count(DISTINCT batch_id) AS batch_count FROM lbx GROUP BY ALL"
SQL["issues_by_type"] = " UNION ALL ".join(
    f"SELECT '{n}' AS issue_type, count(DISTINCT batch_id) AS affected_batches FROM lbx WHERE {c}"
    for n, c in {
        "REPORTABLE_RECON_DIFF": "g_reportable <> 0", "ELIGIBILITY_RECON_DIFF": "g_eligibility <> 0",
        "TRANSFORMATION_FAILURE": FAIL, "DUPLICATE_TRANSFORMATION": "duplicate_transformation > 0",
    }.items()
)
SQL["report_group_health"] = f"""
    SELECT rpt_grp_id, rpt_grp_name, batches_run, batches_run - issue_batches AS healthy_batches, issue_batches,
           coalesce(e, 0) AS expected_rule_hits, coalesce(m, 0) AS matched_rule_hits, coalesce(x, 0) AS missed_rule_hits,
           transformation_failures, latest_batch_timestamp
    FROM (SELECT rpt_grp_id, rpt_grp_name, count(DISTINCT batch_id) AS batches_run, {dst('batch_id', ISSUE, 'issue_batches')},
                 {tot('activity_transformation_failed', 'transformation_failures')}, max(created_timestamp) AS latest_batch_timestamp
          FROM lbx GROUP BY ALL)
    LEFT JOIN (SELECT rpt_grp_id, {tot(SRC, 'e')}, {tot(TGT, 'm')}, {tot(MIS, 'x')} FROM lr GROUP BY ALL) USING (rpt_grp_id)"""
SQL["problem_batches"] = f"""
    SELECT batch_id, rpt_grp_id, rpt_grp_name, expected_reportable_txn, actual_reportable_txn, g_reportable AS reportable_diff,
           expected_activity_eligible_for_transformation, actual_activity_eligible_for_transformation, g_eligibility AS eligibility_diff,
           activity_transformation_failed, duplicate_transformation, modified_timestamp FROM lbx WHERE {ISSUE}"""


def only(sql: str, cond: str) -> str:
    """The statement over those of the latest batches that meet the condition."""
    return sql.replace("FROM lbx", f"FROM (SELECT * FROM lbx WHERE {cond}) lbx")


def met(table: str, cond: str, batch: str = "batch_id", more: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM {table} o WHERE o.rpt_grp_id = lbx.rpt_grp_id AND o.{batch} = lbx.batch_id {more} AND {cond})"


_ASIA = "rpt_grp_id IN (SELECT rpt_grp_id FROM group_config WHERE country_name = 'ASIA')"
SQL["kpi_cards__status"] = only(STEPS["kpi"], met("batch_info", "batch_status = 'Generated'", more="AND o.seq_no = lbx.seq_no"))
SQL["kpi_cards__group"] = only(STEPS["kpi"], "rpt_grp_id = 105 AND batch_id = 'B199607'")
SQL["dashboard_summary__country"] = f"SELECT * FROM ({only(STEPS['kpi'], _ASIA)}), ({STEPS['hit_sums']} WHERE {_ASIA})"
SQL["batch_health__rule"] = only(SQL["batch_health"], met("hits", "rule_id = 'R7' AND source = 'TARGET'", "efile_batch_id"))
SQL["issues_by_type__stage"] = only(SQL["issues_by_type"], met("journey", "stage = 'TRANSACTION_JOIN'"))
SQL["report_group_health__country"] = only(SQL["report_group_health"], _ASIA)
SQL["problem_batches__issue"] = only(SQL["problem_batches"], "coalesce(duplicate_transformation, 0) > 0")
SQL["operations_trend"] = f"""
    SELECT created_timestamp::DATE AS day, count(DISTINCT batch_id) AS batches_run, {dst('batch_id', ISSUE, 'issue_batches')},
           {tot('activity_transformation_failed', 'transformation_failures')} FROM lbx GROUP BY 1"""
SQL["report_group_batches"] = f"""
    SELECT rpt_grp_id, batch_id, created_timestamp, seq_no, txn_selected, expected_reportable_txn, actual_reportable_txn,
           activity_transformed, activity_transformation_failed, duplicate_transformation,
           expected_activity_eligible_for_transformation, actual_activity_eligible_for_transformation,
           {health('CRITICAL', 'NEEDS_ATTENTION', 'HEALTHY')} AS status FROM lbx"""
SQL["batch_control_summary"] = """
    SELECT batch_id, rpt_grp_id, rpt_grp_name, seq_no, created_timestamp, modified_timestamp, txn_selected, excluded_txn,
           already_reported_count, expected_reportable_txn, actual_reportable_txn,
           expected_reportable_txn - actual_reportable_txn AS reportable_diff, expected_activity_eligible_for_transformation,
           actual_activity_eligible_for_transformation,
           expected_activity_eligible_for_transformation - actual_activity_eligible_for_transformation AS eligibility_diff,
           activity_transformed, activity_transformation_failed, duplicate_transformation, soft_dedup_dropped_txn_count FROM any_lb"""
SQL["recon_trend"] = f"SELECT run_date, {tot(SRC, 'expected')}, {tot(TGT, 'matched')}, {tot(MIS, 'missed')} FROM lr GROUP BY run_date"
SQL["recon_by_group"] = f"""
    SELECT *, {pct('matched', 'expected')} AS match_rate_pct FROM (SELECT rpt_grp_id, rpt_grp_name, {tot(SRC, 'expected')},
        {tot(TGT, 'matched')}, {tot(MIS, 'missed')} FROM lr GROUP BY ALL)"""
SQL["recon_group_runs"] = f"""
    SELECT rpt_grp_id, rpt_grp_name, run_date, seq_no, {SRC} AS expected, {TGT} AS matched, {MIS} AS missed, {PUB}, modified_timestamp FROM lr"""
SQL["transformation_summary"] = f"""
    SELECT {tot('txn_selected', 'selected_for_processing')}, {tot('excluded_txn')}, {tot('already_reported_count', 'already_reported')},
           {tot('excluded_txn + coalesce(already_reported_count, 0)', 'filtered_not_eligible')}, {tot('txn_missing_attempt_count')},
           {tot('expected_reportable_txn', 'expected_reportable')}, {tot('actual_reportable_txn', 'actual_reportable')},
           {tot('activity_transformed', 'transformed')}, {tot('activity_transformation_failed', 'transformation_failed')},
           {tot('duplicate_transformation')}, {tot('soft_dedup_dropped_txn_count', 'soft_dedup_dropped')} FROM lb"""
SQL["transformation_flow"] = f"""
    SELECT {raw('txn_selected', 'selected_for_processing')}, {raw('excluded_txn')}, {raw('already_reported_count', 'already_reported')},
           {tot('excluded_txn + coalesce(already_reported_count, 0)', 'filtered_not_eligible')}, {raw('txn_missing_attempt_count', 'join_errors')},
           {raw('expected_reportable_txn', 'expected_reportable')}, {raw('actual_reportable_txn', 'actual_reportable')},
           {raw('activity_transformed', 'transformation_success')}, {raw('activity_transformation_failed', 'transformation_failed')},
           {raw('duplicate_transformation')}, {raw('soft_dedup_dropped_txn_count', 'soft_dedup_dropped')} FROM lb"""
SQL["reportable_recon"] = f"""SELECT {tot('expected_reportable_txn', 'expected_reportable')}, {tot('actual_reportable_txn', 'actual_reportable')},
    {raw('g_reportable', 'reportable_difference')} FROM lbx"""
SQL["eligibility_recon"] = f"""SELECT {tot('expected_activity_eligible_for_transformation', 'expected_eligible')},
    {tot('actual_activity_eligible_for_transformation', 'actual_eligible')}, {raw('g_eligibility', 'eligibility_difference')} FROM lbx"""
OFF = "(g_reportable <> 0 OR g_eligibility <> 0 OR g_transformation_with_dup <> 0)"
RAW_DUP = "actual_activity_eligible_for_transformation - (coalesce(activity_transformed, 0) + coalesce(activity_transformation_failed, 0) + coalesce(duplicate_transformation, 0))"
RAW_OFF = f"""(expected_reportable_txn <> actual_reportable_txn
    OR expected_activity_eligible_for_transformation <> actual_activity_eligible_for_transformation OR {RAW_DUP} <> 0)"""
for _n, _c in (("recon_issue_counts", OFF), ("recon_issue_counts_raw", RAW_OFF)):
    SQL[_n] = f"""SELECT {cnt(_c, 'reconciliation_issues')}, {dst('rpt_grp_id', _c, 'affected_report_groups')},
        {dst('batch_id', _c, 'affected_batches')} FROM lbx"""
_DETAIL = """batch_id, rpt_grp_id, rpt_grp_name, expected_reportable_txn, actual_reportable_txn, expected_activity_eligible_for_transformation,
    actual_activity_eligible_for_transformation, activity_transformed, activity_transformation_failed, duplicate_transformation"""
SQL["recon_issue_detail"] = f"""SELECT {_DETAIL}, g_reportable AS reportable_diff, g_eligibility AS activity_eligibility_diff,
    g_transformation_with_dup AS transformation_disposition_diff, created_timestamp, modified_timestamp FROM lbx WHERE {OFF}"""
SQL["recon_issue_detail_raw"] = f"""SELECT {_DETAIL}, expected_reportable_txn - actual_reportable_txn AS reportable_diff,
    expected_activity_eligible_for_transformation - actual_activity_eligible_for_transformation AS eligibility_diff,
    {RAW_DUP} AS transformation_diff FROM lbx WHERE {RAW_OFF}"""
SQL["batch_health_table"] = f"""SELECT {_DETAIL}, seq_no, txn_selected, txn_missing_attempt_count, g_reportable AS reportable_diff,
    g_eligibility AS eligibility_diff, {health('NEEDS ATTENTION', 'WARNING', 'HEALTHY')} AS batch_status, modified_timestamp AS last_updated FROM lbx"""
SQL["batch_full_detail"] = "SELECT * FROM batch_recon"
SQL["failures_by_batch"] = "SELECT rpt_grp_id, rpt_grp_name, batch_id, activity_transformation_failed AS failed_count, modified_timestamp FROM lb WHERE activity_transformation_failed > 0"
for _n, (_a, _b) in SIDES.items():
    SQL[f"ctl_{_n}"] = f"""SELECT rpt_grp_id, batch_id, {z(_a)} AS left_side, {' + '.join(z(x) for x in _b)} AS right_side,
        g_{_n} AS difference, g_{_n} = 0 AS balanced FROM lbx"""
SQL["ctl_rule_hits"] = f"SELECT rpt_grp_id, run_date, {SRC} - {TGT} - {MIS} AS difference, {SRC} = {TGT} + {MIS} AS balanced FROM lr"
SQL["ctl_rule_hits_publish"] = f"SELECT rpt_grp_id, run_date, {MIS} - {PUB} + {TGT} AS difference, {MIS} + {TGT} = {PUB} AS balanced FROM lr"

# Validation
_IN_PT = f"process_timestamp >= {START} AND process_timestamp < {AFTER}"
SQL["val_batch_join_time"] = f"""
    SELECT count(*) AS transformation_batches, count(has_info) AS exact_batch_info_matches, {cnt('has_info IS NULL', 'unmatched_batches')},
           {cnt('has_info AND process_timestamp IS NULL', 'process_timestamp_null')}, {cnt(_IN_PT, 'process_timestamp_inside')},
           {cnt(f'NOT ({_IN_PT})', 'process_timestamp_outside')} FROM lbi"""
SQL["val_batch_join_time__status"] = "SELECT 'batch_status' AS field, coalesce(batch_status, '<NULL>') AS value, count(*) AS row_count FROM lbi WHERE has_info GROUP BY ALL"
SQL["val_batch_join_time__unmatched"] = """SELECT rpt_grp_id, rpt_grp_name, batch_id, seq_no, created_timestamp FROM lbi WHERE has_info IS NULL
    ORDER BY created_timestamp DESC, rpt_grp_id, batch_id"""
SQL["val_batch_join_time__timing"] = """SELECT rpt_grp_id, rpt_grp_name, batch_id, seq_no, created_timestamp AS reconciliation_created_timestamp,
    process_timestamp, batch_info_created_timestamp, batch_status, compiler_status, report_status FROM lbi WHERE has_info
    ORDER BY process_timestamp DESC NULLS LAST, rpt_grp_id, batch_id"""


def balances(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS control, {cnt(f'g_{n} = 0', 'balanced')}, {cnt(f'g_{n} <> 0', 'unbalanced')}, max(abs(g_{n})) AS max_difference FROM lbx"
        for n in names
    )


SQL["val_control_equations"] = balances(["reportable", "lookback", "reporting_period", "activity", "transformation", "transformation_with_dup"])
SQL["val_control_equations__mismatches"] = """
    SELECT rpt_grp_id, rpt_grp_name, batch_id, expected_reportable_txn, actual_reportable_txn, -g_reportable AS reportable_difference,
           activity_selected, lookback_txn, reporting_period_txn, activity_simulated, actual_activity_eligible_for_transformation,
           activity_transformed, activity_transformation_failed, duplicate_transformation, g_transformation AS transformation_difference
    FROM lbx WHERE g_reportable <> 0 OR g_activity <> 0 OR g_transformation <> 0
    ORDER BY abs(g_reportable) DESC, rpt_grp_id, batch_id"""
_LF, _PF = "coalesce(lookback_future_reporting_txn, 0)", "coalesce(reporting_period_future_reporting_txn, 0)"
_WIN = "lookback_txn lookback_actual_txn lookback_future_reporting_txn reporting_period_txn reporting_period_actual_txn reporting_period_future_reporting_txn".split()
SQL["val_future_reporting"] = f"""SELECT count(*) AS total_batches, {cnt(f'{_LF} > 0', 'batches_with_lookback_future_reporting')},
    {cnt(f'{_PF} > 0', 'batches_with_reporting_period_future_reporting')}, {cnt(f'{_LF} + {_PF} > 0', 'batches_with_any_future_reporting')},
    {', '.join(sure(c, 'sum_' + c) for c in _WIN)} FROM lb"""
SQL["val_future_reporting__largest"] = f"""SELECT rpt_grp_id, rpt_grp_name, batch_id, {', '.join(_WIN)}, {_LF} + {_PF} AS total_future_reporting
    FROM lb WHERE {_LF} + {_PF} > 0 ORDER BY total_future_reporting DESC, rpt_grp_id, batch_id"""


def journey_check(pairs: dict[str, str]) -> tuple[str, str]:
    facts = ["count(*) AS total_batches", cnt("journey_rows > 0", "batches_with_any_journey")]
    for n, c in pairs.items():
        facts += [
            cnt(f"{c} > 0", f"{n}_metric_nonzero"), cnt(f"{z(c)} = {n}_rows", f"{n}_balanced"),
            cnt(f"journey_rows > 0 AND {z(c)} = {n}_rows", f"{n}_balanced_with_journey"),
            cnt(f"{c} > 0 AND {n}_rows = 0", f"{n}_metric_without_marker"),
        ]
    cols = ", ".join([*pairs.values(), "journey_rows", *[f"{n}_rows" for n in pairs]])
    bad = " OR ".join(f"{z(c)} <> {n}_rows" for n, c in pairs.items())
    last = list(pairs.values())[-1]
    return (
        f"SELECT {', '.join(facts)} FROM journey_cmp",
        f"SELECT rpt_grp_id, rpt_grp_name, batch_id, {cols} FROM journey_cmp WHERE {bad} ORDER BY {z(last)} DESC, rpt_grp_id, batch_id",
    )


for _n, _p in {
    "val_already_reported": {"already_reported": "already_reported_count"},
    "val_missing_attempt": {"missing_attempt": "txn_missing_attempt_count"},
    "val_transformed_failed": {"transformed": "activity_transformed", "failed": "activity_transformation_failed"},
}.items():
    SQL[_n], SQL[f"{_n}__mismatches"] = journey_check(_p)
SQL["val_duplicates"] = f"""SELECT count(*) AS total_batches, {cnt('duplicate_transformation > 0', 'batches_with_duplicates')},
    {sure('duplicate_transformation', 'total_duplicates')} FROM lb"""
SQL["val_duplicates__largest"] = """SELECT rpt_grp_id, rpt_grp_name, batch_id, duplicate_transformation, activity_transformed,
    activity_transformation_failed FROM lb WHERE duplicate_transformation > 0 ORDER BY duplicate_transformation DESC, rpt_grp_id, batch_id"""
SQL["json_row"] = f"SELECT 'summary' AS section, to_json(d)::VARCHAR AS result FROM ({SQL['val_duplicates']}) d"
SQL["val_rule_hit_linkage"] = f"""SELECT count(*) AS rule_hit_rows, count(DISTINCT (h.rpt_grp_id, h.efile_batch_id)) AS distinct_batches,
    {cnt('is_reported = false', 'is_reported_false')}, {cnt('is_reported', 'is_reported_true')}, {cnt('is_reported IS NULL', 'is_reported_null')}
    FROM hits h JOIN runs r ON r.rpt_grp_id = h.rpt_grp_id AND r.batch_id = h.efile_batch_id"""
_AUD = "FROM audit a JOIN runs r ON r.rpt_grp_id = a.rpt_grp_id AND r.batch_id = a.processing_batch_id"
SQL["val_exclusion_audit"] = f"SELECT count(*) AS audit_rows, count(DISTINCT (a.rpt_grp_id, processing_batch_id)) AS distinct_batches {_AUD}"
SQL["val_exclusion_audit__reasons"] = f"SELECT coalesce(exclusion_reason_id, '<NULL>') AS reason, count(*) AS row_count {_AUD} GROUP BY 1"
SQL["val_recon_grains"] = f"""SELECT count(*) AS total_rows, count(DISTINCT rpt_grp_id) AS distinct_report_groups,
    count(DISTINCT (rpt_grp_id, run_date, seq_no)) AS distinct_runs, {cnt(f'{SRC} = {TGT} + {MIS}', 'balanced_rows')},
    {cnt(f'{SRC} <> {TGT} + {MIS}', 'unbalanced_rows')}, {sure(SRC, 'expected_rule_hits')}, {sure(TGT, 'matched_rule_hits')},
    {sure(MIS, 'missed_rule_hits')} FROM hit_recon WHERE {INSIDE}"""
SQL["val_recon_grains__groups"] = f"SELECT rpt_grp_name AS report_group, count(*) AS row_count FROM hit_recon WHERE {INSIDE} GROUP BY 1"


def values_of(table: str, where: str, *cols: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, coalesce({c}, '<NULL>') AS value, count(*) AS row_count FROM {table} WHERE {where} GROUP BY ALL" for c in cols
    )


SQL["disc_batch_status"] = values_of("batch_info", _IN_PT, "batch_status", "compiler_status", "report_status")


def three(flag: str, name: str) -> str:
    return f"{cnt(flag, name + '_true')}, {cnt('NOT ' + flag, name + '_false')}, {cnt(flag + ' IS NULL', name + '_null')}"


_RUNS = "count(*) AS row_count, count(DISTINCT (run_date, seq_no, rpt_grp_id)) AS distinct_runs, count(DISTINCT rpt_grp_id) AS distinct_report_groups"
SQL["val_recon_detail_populations__log"] = f"SELECT {_RUNS}, {three('is_processed', 'processed')}, {three('is_reported', 'reported')} FROM recon_log WHERE {INSIDE}"
SQL["val_recon_detail_populations__log_values"] = values_of("recon_log", INSIDE, "status", "data_source")
SQL["val_recon_detail_populations__analysis"] = f"SELECT {_RUNS} FROM recon_analysis WHERE {INSIDE}"
SQL["val_recon_detail_populations__analysis_values"] = values_of("recon_analysis", INSIDE, "description")
SQL["val_recon_detail_populations__unprocessed"] = f"SELECT count(*) AS row_count, count(DISTINCT rpt_grp_id) AS distinct_report_groups, {three('is_reported', 'reported')} FROM unprocessed WHERE {INSIDE}"
SQL["val_recon_detail_populations__unprocessed_values"] = values_of("unprocessed", INSIDE, "status", "data_source")
SQL["val_recon_detail_linkage"] = f"""SELECT count(*) AS reconciliation_rows, {cnt('log_rows > 0', 'rows_with_log_evidence')},
    {cnt('log_rows = 0', 'rows_without_log_evidence')}, {cnt('analysis_rows > 0', 'rows_with_analysis_evidence')},
    {cnt('analysis_rows = 0', 'rows_without_analysis_evidence')}, {cnt('missed_rule_hits > 0', 'rows_with_misses')},
    {cnt('missed_rule_hits > 0 AND log_rows > 0', 'miss_rows_with_log_evidence')},
    {cnt('missed_rule_hits > 0 AND analysis_rows > 0', 'miss_rows_with_analysis_evidence')} FROM linkage"""
SQL["val_recon_detail_linkage__samples"] = "SELECT * FROM linkage ORDER BY missed_rule_hits DESC, expected_rule_hits DESC, rpt_grp_id, run_date, seq_no"
SQL["val_missed_hit_evidence"] = f"""SELECT count(*) AS reconciliation_rows_with_misses, {sure('expected_rule_hits', 'total_expected_rule_hits')},
    {sure('matched_rule_hits', 'total_matched_rule_hits')}, {sure('missed_rule_hits', 'total_missed_rule_hits')},
    {', '.join(cnt(f'{c} = missed_rule_hits', f'rows_where_{c}_equals_missed') for c in ('log_not_processed', 'log_not_reported', 'log_not_processed_not_reported', 'analysis_rows'))}
    FROM missed_cmp"""
SQL["val_missed_hit_evidence__samples"] = "SELECT * FROM missed_cmp ORDER BY missed_rule_hits DESC, rpt_grp_id, run_date, seq_no"
_COMPLETE = "compiler_status IS NOT DISTINCT FROM 'Report Generation Completed'"
SQL["val_report_generation"] = f"""SELECT count(*) AS total_batches, {cnt('generated_txn > 0', 'batches_with_generation_evidence')},
    {cnt('actual > 0', 'batches_with_actual_reportable')}, {cnt('difference = 0', 'exact_match_batches')},
    {cnt('difference < 0', 'generated_less_than_actual')}, {cnt('difference > 0', 'generated_greater_than_actual')},
    {raw('actual', 'sum_actual_reportable')}, {raw('generated_txn', 'sum_generated')},
    {cnt(f'{_COMPLETE} AND generated_txn = 0', 'completed_with_zero_generated')},
    {cnt(f'NOT {_COMPLETE} AND generated_txn > 0', 'generated_but_not_completed')} FROM generation"""
SQL["val_report_generation__compiler"] = f"SELECT coalesce(compiler_status, '<NULL>') AS compiler_status, {raw('generated_txn')} FROM generation GROUP BY 1"
SQL["val_report_generation__mismatches"] = """SELECT rpt_grp_id, rpt_grp_name, batch_id, seq_no, actual AS actual_reportable_txn, generated_txn,
    difference, report_status, compiler_status, batch_status FROM generation ORDER BY abs(difference) DESC, rpt_grp_id, batch_id"""
SQL["val_rule_hit_recon__rows"] = f"""SELECT rpt_grp_id, rpt_grp_name, run_date, seq_no, {SRC}, {PUB}, {TGT}, {MIS},
    {SRC} - {TGT} AS distinct_minus_matched, {PUB} - {TGT} AS publish_minus_matched, {MIS} - {SRC} + {TGT} AS variance_vs_distinct,
    {MIS} - {PUB} + {TGT} AS variance_vs_publish FROM lr"""
SQL["val_rule_hit_recon"] = f"""SELECT count(*) AS total_reconciliation_rows, {cnt('variance_vs_distinct = 0', 'distinct_equation_balances')},
    {cnt('variance_vs_distinct <> 0', 'distinct_equation_fails')}, {cnt('variance_vs_publish = 0', 'publish_equation_balances')},
    {cnt('variance_vs_publish <> 0', 'publish_equation_fails')} FROM ({SQL['val_rule_hit_recon__rows']})"""
SQL["val_transformation_waterfall"] = balances(["selection", "transformation_with_dup"])
SQL["val_transformation_waterfall__details"] = """SELECT batch_id, rpt_grp_id, rpt_grp_name, txn_selected, excluded_txn, txn_missing_attempt_count,
    already_reported_count, expected_reportable_txn, g_selection AS selection_balance_diff, actual_activity_eligible_for_transformation,
    activity_transformed, activity_transformation_failed, duplicate_transformation, g_transformation_with_dup AS transformation_balance_diff FROM lbx"""
_CAND = """txn_simulated lookback_txn lookback_future_reporting_txn lookback_actual_txn reporting_period_txn
    reporting_period_future_reporting_txn reporting_period_actual_txn activity_selected activity_missing activity_simulated""".split()
_WORST = "SELECT * FROM lbx WHERE g_selection <> 0 ORDER BY abs(g_selection) DESC, rpt_grp_id, batch_id"
_SELSUM = f"count(*) AS unbalanced_batches, max(abs(g_selection)) AS max_selection_difference, {', '.join(tot(c) for c in _CAND)}"
SQL["val_selection_balance"] = f"SELECT {_SELSUM} FROM lbx WHERE g_selection <> 0"
SQL["val_selection_balance__top"] = f"""SELECT batch_id, rpt_grp_id, rpt_grp_name, g_selection AS selection_balance_diff, txn_selected, excluded_txn,
    txn_missing_attempt_count, already_reported_count, expected_reportable_txn, {', '.join(_CAND)} FROM ({_WORST})"""
_REL = ["expected_vs_selected", "activity", "lookback", "reporting_period", "transformation_with_dup"]
SQL["val_control_relationships"] = balances(_REL)
SQL["val_control_relationships__exceptions"] = f"""SELECT batch_id, rpt_grp_id, rpt_grp_name, expected_reportable_txn, activity_selected, lookback_txn,
    reporting_period_txn, {', '.join(f'g_{n} AS {n}_diff' for n in _REL)} FROM lbx WHERE {' OR '.join(f'g_{n} <> 0' for n in _REL)}"""

# Bridges
SQL["batch_bridge_candidates"] = " UNION ALL ".join(
    f"""SELECT '{label}.{c}' AS candidate_bridge, count(*) AS matched_rows, count(DISTINCT (d.rpt_grp_id, d.{c})) AS matched_batch_keys
        FROM {table} d JOIN runs r ON r.rpt_grp_id = d.rpt_grp_id AND r.batch_id = d.{c}::VARCHAR"""
    for label, table, cols in (
        ("rule_hit", "hits", ("batch_id", "efile_batch_id", "reported_batch_id")),
        ("exclusion_audit", "audit", ("processing_batch_id", "reported_batch_id")),
    )
    for c in cols
)
_JB = f"(SELECT DISTINCT rpt_grp_id, batch_id FROM journey WHERE {INSIDE} AND batch_id IS NOT NULL)"
SQL["journey_without_recon"] = f"""SELECT count(*) AS journey_batches, count(known) AS with_reconciliation, {cnt('known IS NULL', 'without_reconciliation')}
    FROM {_JB} LEFT JOIN (SELECT *, 1 AS known FROM runs) USING (rpt_grp_id, batch_id)"""
SQL["journey_without_recon__missing"] = f"SELECT * FROM {_JB} ANTI JOIN runs USING (rpt_grp_id, batch_id)"
SQL["bridge_by_group"] = f"""SELECT count(*) AS transformation_batches, {cnt('rule_hit_rows > 0', 'batches_with_rule_hits')},
    {cnt('exclusion_rows > 0', 'batches_with_exclusions')}, {cnt('rule_hit_rows > 0 AND exclusion_rows > 0', 'batches_with_both')} FROM hit_audit_batches"""
SQL["bridge_by_group__groups"] = f"""SELECT rpt_grp_id, rpt_grp_name, count(*) AS transformation_batches, {cnt('rule_hit_rows > 0', 'batches_with_rule_hits')},
    {cnt('exclusion_rows > 0', 'batches_with_exclusions')},
    {', '.join(raw(c, 'total_' + c) for c in ('rule_hit_rows', 'distinct_rules', 'distinct_mtcns', 'exclusion_rows'))}
    FROM hit_audit_batches GROUP BY ALL"""
SQL["bridge_by_group__samples"] = "SELECT * FROM hit_audit_batches WHERE rule_hit_rows > 0 OR exclusion_rows > 0 ORDER BY rule_hit_rows DESC, rpt_grp_id, batch_id"
SQL["txn_bridge_candidates"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS candidate, count(*) AS matched_transactions, {cnt('k = 1', 'uniquely_matched_transactions')},
        {cnt('k > 1', 'ambiguous_transactions')} FROM (
            SELECT jt.rpt_grp_id, jt.batch_id, identifier, count(DISTINCT ext) AS k FROM jt JOIN hk
            ON hk.rpt_grp_id = jt.rpt_grp_id AND hk.batch_id = jt.batch_id AND {on} GROUP BY ALL)"""
    for n, on in (
        ("txn_metadata.txn_sur_key -> rule_hit.external_txn_key", "ext::VARCHAR = sur"),
        ("journey.mtcn -> rule_hit.mtcn", "hk.mtcn = jt.mtcn"),
        ("journey.identifier -> rule_hit.external_txn_key", "ext::VARCHAR = identifier"),
    )
)
SQL["txn_bridge_candidates__totals"] = "SELECT count(*) AS total_journey_transactions, count(sur) AS with_txn_sur_key, count(mtcn) AS with_mtcn FROM jt"
SQL["missed_definition_candidates"] = f"""SELECT count(*) AS reconciliation_populations,
    {', '.join(cnt(f'variance_{n} = 0', f'{n}_exact_matches') for n in DEFINITIONS)} FROM def_rows"""
SQL["missed_definition_candidates__rows"] = "SELECT * FROM def_rows"
SQL["missed_definition_candidates__by_created"] = definition_rows(
    "lr_made", "defs_made",
    {n: 1 for n in ("distinct_rule_hit_keys", "missed_is_reported_not_true", "missed_reporting_timestamp_null", "missed_reported_batch_null")},
)


def window_count(column: str, low: str, high: str, name: str) -> str:
    return f"""(SELECT r.rpt_grp_id, r.run_date, count(*) AS {name} FROM any_lr r JOIN hits h ON h.rpt_grp_id = r.rpt_grp_id
        AND h.{column} BETWEEN {low} AND {high} GROUP BY ALL)"""


_WINDOWS = {
    "by_transaction_date": ("transaction_date", "data_selection_start_date", "data_selection_end_date"),
    "by_created_timestamp": ("created_timestamp", "data_selection_start_date", "data_selection_end_date"),
    "by_reporting_timestamp": ("reporting_timestamp", "data_selection_start_date", "data_selection_end_date"),
    "created_within_7_days": ("created_timestamp", "r.created_timestamp - INTERVAL 7 DAY", "r.created_timestamp + INTERVAL 7 DAY"),
}
SQL["locate_recon_detail"] = f"""SELECT rpt_grp_id, run_date, seq_no, rpt_grp_name, created_timestamp, modified_timestamp, data_selection_start_date,
    data_selection_end_date, {SRC} AS expected, {TGT} AS matched, {MIS} AS missed, coalesce(total, 0) AS all_rule_hit_rows,
    {', '.join(f'coalesce({n}, 0) AS {n}' for n in _WINDOWS)}
    FROM any_lr LEFT JOIN (SELECT rpt_grp_id, count(*) AS total FROM hits GROUP BY ALL) USING (rpt_grp_id)
    {' '.join(f'LEFT JOIN {window_count(c, a, b, n)} USING (rpt_grp_id, run_date)' for n, (c, a, b) in _WINDOWS.items())}"""
SQL["locate_recon_detail__samples"] = """SELECT rpt_grp_id, rule_id, attempt_id, bucket_id, external_txn_key, mtcn, is_reported,
    exclusion_reason_id, transaction_date, created_timestamp, reporting_timestamp, efile_batch_id, reported_batch_id
    FROM hits SEMI JOIN any_lr USING (rpt_grp_id)"""

# Journey
SQL["latest_stage"] = "SELECT * FROM ls"
SQL["stage_status"] = "SELECT stage, status, count(DISTINCT identifier) AS transaction_count FROM ls GROUP BY ALL"
SQL["failure_reasons"] = """SELECT stage, CASE WHEN stage ILIKE 'transaction_join' AND (status ILIKE 'error' OR skip_reason ILIKE '%not yet recorded%') THEN 'ATTEMPT_NOT_RECEIVED'
        WHEN stage ILIKE 'transformation' AND upper(status) IN ('FAILURE', 'FAILED') THEN 'TRANSFORMATION_FAILURE'
        WHEN length(skip_reason) > 0 THEN 'OTHER_SKIP_REASON' ELSE 'OTHER_FAILURE' END AS reason_category,
    count(DISTINCT identifier) AS affected_transactions FROM ls WHERE skip_reason IS NOT NULL OR upper(coalesce(status, '')) <> 'SUCCESS' GROUP BY ALL"""
_STATE = "identifier, mtcn, rpt_grp_id, batch_id, stage, status, comments, skip_reason, created_timestamp, modified_timestamp"
SQL["transformation_failures"] = f"SELECT {_STATE}, processing_complete, reporting_timestamp_latest, txn_metadata FROM ls WHERE stage = 'TRANSFORMATION' AND status IN ('FAILURE', 'FAILED')"
SQL["failed_transactions"] = f"SELECT {_STATE}, reporting_timestamp_latest FROM journey WHERE status IN ('FAILURE', 'FAILED')"
SQL["attempt_not_received"] = f"SELECT {_STATE}, txn_metadata FROM ls WHERE stage = 'TRANSACTION_JOIN' AND (status = 'ERROR' OR skip_reason ILIKE '%not yet recorded%')"
SQL["join_problems"] = f"SELECT {_STATE}, txn_metadata FROM journey WHERE stage = 'TRANSACTION_JOIN' AND (status IN ('ERROR', 'FAILURE', 'FAILED') OR skip_reason IS NOT NULL)"
SQL["txn_journey"] = f"SELECT {_STATE}, processing_complete, reporting_timestamp_latest, txn_metadata FROM journey"
SQL["txn_journey_global"] = SQL["txn_journey"]
SQL["journey_profile"] = f"SELECT stage, status, skip_reason, count(*) AS record_count FROM journey WHERE {INSIDE} GROUP BY ALL"
SQL["journey_markers"] = f"""SELECT rpt_grp_id, batch_id, count(*) AS journey_rows,
    {cnt("comments = 'EXCLUDED_BECAUSE_ALREADY_REPORTED(TARGET)' AND stage = 'FILTRATION' AND status = 'EXCLUDED'", 'already_reported')},
    {cnt("comments = 'ATTEMPT_NOT_RECEIVED' AND stage = 'TRANSACTION_JOIN' AND status = 'ERROR'", 'missing_attempt')},
    {cnt("stage = 'TRANSFORMATION' AND status = 'SUCCESS'", 'transformed')}, {cnt("stage = 'TRANSFORMATION' AND status = 'FAILURE'", 'failed')},
    {cnt("stage = 'TRANSFORMATION' AND status = 'FAILURE' AND comments = 'TRANSFORMATION_SKIPPED'", 'failed_and_skipped')},
    {cnt("stage = 'REPORT_GENERATION' AND status = 'GENERATED'", 'generated')} FROM journey GROUP BY ALL"""


def evidence(table: str, batch: str, key: str, name: str, cols: str, alias: str) -> str:
    return f"LEFT JOIN (SELECT rpt_grp_id, {batch} AS batch_id, {key} AS {name}, {cols} FROM {table} WHERE {batch} IS NOT NULL GROUP BY ALL) {alias} USING (rpt_grp_id, batch_id, {name})"


_HIT = "count(*) AS {p}n, min(rule_id) AS {p}r1, max(rule_id) AS {p}r2, max(external_txn_key) AS {p}k, max(exclusion_reason_id) AS {p}x, max(reported_batch_id) AS {p}b"
_AUDIT = "count(*) AS {p}n, max(exclusion_reason_id) AS {p}x, max(exclusion_strategy) AS {p}s"
_TEXT = "external_txn_key::VARCHAR"
SQL["txn_root_cause"] = f"""SELECT j.rpt_grp_id, batch_id, identifier, mtcn, stage, status, comments, skip_reason,
    CASE WHEN h1n IS NOT NULL THEN 'mtcn' WHEN h2n IS NOT NULL THEN 'identifier' END AS bridge, coalesce(h1n, h2n, 0) AS rule_hit_rows,
    if(h1n IS NULL, h2r1, h1r1) AS first_rule_id, if(h1n IS NULL, h2r2, h1r2) AS last_rule_id, if(h1n IS NULL, h2k, h1k) AS external_txn_key,
    if(h1n IS NULL, h2x, h1x) AS hit_exclusion_reason, if(h1n IS NULL, h2b, h1b) AS reported_batch_id, coalesce(a1n, a2n, 0) AS audit_rows,
    if(a1n IS NULL, a2x, a1x) AS audit_exclusion_reason, if(a1n IS NULL, a2s, a1s) AS audit_exclusion_strategy
    FROM journey j {evidence('hits', 'efile_batch_id', 'mtcn', 'mtcn', _HIT.format(p='h1'), 'p1')}
    {evidence('hits', 'efile_batch_id', _TEXT, 'identifier', _HIT.format(p='h2'), 'p2')}
    {evidence('audit', 'processing_batch_id', 'mtcn', 'mtcn', _AUDIT.format(p='a1'), 'p3')}
    {evidence('audit', 'processing_batch_id', _TEXT, 'identifier', _AUDIT.format(p='a2'), 'p4')}"""
SQL["evidence_tabs"] = """SELECT rpt_grp_id, batch_id,
    EXISTS (FROM journey j WHERE j.rpt_grp_id = lb.rpt_grp_id AND j.batch_id = lb.batch_id) AS has_journey,
    EXISTS (FROM hits h WHERE h.rpt_grp_id = lb.rpt_grp_id AND h.efile_batch_id = lb.batch_id) AS has_rule_hits,
    EXISTS (FROM audit a WHERE a.rpt_grp_id = lb.rpt_grp_id AND a.processing_batch_id = lb.batch_id) AS has_exclusions FROM lb"""

# Rule hits, weekly pack and page measures
SQL["rule_hit_detail"] = """SELECT rpt_grp_id, rpt_grp_name, rule_id, attempt_id, external_txn_key, galactic_id, mtcn, activity_type, exclusion_reason_id,
    is_reported, batch_id, efile_batch_id, reported_batch_id, transaction_date, reporting_timestamp, source, transaction_side FROM hits"""
SQL["exclusion_audit_detail"] = "SELECT * FROM audit"
SQL["rule_breakdown"] = f"""SELECT rpt_grp_id, efile_batch_id AS batch_id, rule_id, count(*) AS rule_hits, count(exclusion_reason_id) AS excluded,
    {cnt('is_reported', 'reported')}, {cnt('is_reported = false', 'not_reported')} FROM hits WHERE efile_batch_id IS NOT NULL GROUP BY ALL"""
_REASONS = f"""SELECT exclusion_reason_id, n AS excluded_hits, {pct('n', 'sum(n) OVER ()')} AS pct_of_excluded
    FROM (SELECT exclusion_reason_id, count(*) AS n FROM cohort_hits WHERE exclusion_reason_id IS NOT NULL GROUP BY ALL)"""
SQL["exclusion_reasons"] = _REASONS
SQL["exclusion_defects"] = f"SELECT *, exclusion_reason_id = 'Transaction Cancelled' AS is_defect FROM ({_REASONS})"
SQL["exclusion_audit_summary"] = f"SELECT exclusion_reason_id, exclusion_strategy, count(*) AS excluded_count FROM audit WHERE {INSIDE} GROUP BY ALL"
SQL["is_reported_distribution"] = "SELECT is_reported, count(*) AS hit_count FROM hits GROUP BY ALL"
SQL["is_reported_vs_exclusion"] = f"""SELECT is_reported, if(exclusion_reason_id IS NULL, 'NO_EXCLUSION', 'EXCLUDED') AS exclusion_status, count(*) AS total_rows,
    {cnt('reporting_timestamp IS NULL', 'reporting_timestamp_null')}, count(reporting_timestamp) AS reporting_timestamp_present,
    {cnt('reported_batch_id IS NULL', 'reported_batch_null')}, count(reported_batch_id) AS reported_batch_present FROM hits GROUP BY 1, 2"""


def cohort(names: str) -> str:
    a, b, c, d, e = names.split()
    return f"count(*) AS {a}, count(exclusion_reason_id) AS {b}, {cnt('exclusion_reason_id IS NULL', c)}, {cnt(DONE, d)}, {cnt(OPEN, e)}"


SQL["cohort_balance"] = f"""SELECT *, total_hits - excluded - requires_reporting AS rule_hit_balance_diff, requires_reporting - reported - open AS reporting_balance_diff
    FROM (SELECT {cohort('total_hits excluded requires_reporting reported open')} FROM cohort_hits)"""
SQL["weekly_reporting_health"] = f"""SELECT *, {pct('reported_hits', 'requires_reporting')} AS reported_pct
    FROM (SELECT {cohort('total_rule_hits excluded_hits requires_reporting reported_hits still_open')} FROM cohort_hits)"""
_BANDS = {"0_3": "age BETWEEN 0 AND 3", "4_7": "age BETWEEN 4 AND 7", "8_14": "age BETWEEN 8 AND 14", "15_30": "age BETWEEN 15 AND 30", "30_plus": "age > 30"}
SQL["open_backlog_aging"] = f"""SELECT count(*) AS total_open_backlog, {', '.join(cnt(c, f'open_{n}_days') for n, c in _BANDS.items())},
    max(age)::INT AS oldest_open_days FROM backlog"""
SQL["age_bands"] = " UNION ALL ".join(f"SELECT '{n}' AS age_band, {cnt(c, 'open_hits')} FROM backlog" for n, c in _BANDS.items())
SQL["processing_exceptions"] = f"""SELECT {tot('txn_missing_attempt_count', 'missing_attempts')}, {tot('activity_transformation_failed', 'transformation_failures')},
    sum({z('txn_missing_attempt_count')} + {z('activity_transformation_failed')})::BIGINT AS processing_exceptions FROM lb"""
SQL["exception_breakdown"] = """SELECT a::BIGINT AS attempt_not_received, f::BIGINT AS transformation_failed, (a + f)::BIGINT AS total_processing_exceptions
    FROM (SELECT sum(txn_missing_attempt_count) AS a, sum(activity_transformation_failed) AS f FROM lb)"""
SQL["group_reporting_health"] = f"SELECT rpt_grp_id, rpt_grp_name, {cohort('total_rule_hits excluded requires_reporting reported still_open')} FROM cohort_hits GROUP BY rpt_grp_id, rpt_grp_name"
SQL["group_backlog_health"] = f"SELECT rpt_grp_id, rpt_grp_name, count(*) AS still_open, {cnt('age > 30', 'open_over_30_days')}, max(age)::INT AS oldest_open_days FROM backlog GROUP BY rpt_grp_id, rpt_grp_name"
SQL["group_transformation_health"] = f"""SELECT rpt_grp_id, rpt_grp_name, {raw('txn_selected')}, {raw('excluded_txn')}, {raw('already_reported_count', 'already_reported')},
    {raw('txn_missing_attempt_count', 'join_errors')}, {raw('expected_reportable_txn', 'expected_reportable')}, {raw('actual_reportable_txn', 'actual_reportable')},
    {raw('activity_transformed', 'transformed')}, {raw('activity_transformation_failed', 'transform_failed')},
    {raw('expected_reportable_txn - actual_reportable_txn', 'reportable_recon_diff')} FROM lb GROUP BY rpt_grp_id, rpt_grp_name"""
SQL["batch_health_weekly"] = f"""SELECT batch_id, rpt_grp_id, rpt_grp_name, txn_selected AS selected, {z('excluded_txn')} + {z('already_reported_count')} AS filtered_not_eligible,
    txn_missing_attempt_count AS join_errors, expected_reportable_txn AS eligible, activity_transformed AS success, activity_transformation_failed AS failed,
    {z('txn_missing_attempt_count')} + {z('activity_transformation_failed')} AS needs_attention,
    expected_reportable_txn - actual_reportable_txn AS reconciliation_diff, modified_timestamp AS last_updated FROM lb"""
SQL["daily_reporting_trend"] = f"SELECT transaction_date::DATE AS day, {cnt('exclusion_reason_id IS NULL', 'requires_reporting')}, {cnt(DONE, 'reported')}, {cnt(OPEN, 'open')} FROM cohort_hits GROUP BY 1"
SQL["open_value_by_currency"] = """SELECT if(place <= 3, code, 'mixed') AS currency, sum(n)::BIGINT AS open_hits, max(if(place <= 3, v, NULL)) AS open_amount
    FROM (SELECT rule_iso_currency_code AS code, count(*) AS n, sum(rule_currency_amount)::DECIMAL(38,2) AS v,
        row_number() OVER (ORDER BY count(*) DESC, rule_iso_currency_code) AS place FROM backlog GROUP BY 1) GROUP BY 1"""
SQL["hit_disposition"] = " UNION ALL ".join(
    f"SELECT '{n}' AS level, {cnt(c, 'hits')}, {pct(f'count(*) FILTER ({c})', 'count(*)')} AS pct_of_total FROM cohort_hits"
    for n, c in {
        "1 total": "true", "2 excluded": "exclusion_reason_id IS NOT NULL", "3 requires reporting": "exclusion_reason_id IS NULL",
        "4 reported": DONE, "5 open": OPEN, "6 open over 30 days": f"{OPEN} AND {AGE} > 30",
    }.items()
)
SQL["report_lag"] = """SELECT transaction_date::DATE AS day, count(*) AS reported_hits, round(quantile_cont(lag_days, 0.5), 6) AS median_days,
    round(quantile_cont(lag_days, 0.95), 6) AS p95_days
    FROM (SELECT *, date_diff('day', transaction_date::DATE, reporting_timestamp::DATE)::DOUBLE AS lag_days FROM cohort_hits WHERE reporting_timestamp IS NOT NULL) GROUP BY 1"""
SQL["exclusion_daily_trend"] = """SELECT day, excluded_hits, row_number() OVER (ORDER BY excluded_hits DESC, day) = 1 AS is_peak
    FROM (SELECT transaction_date::DATE AS day, count(*) AS excluded_hits FROM cohort_hits WHERE exclusion_reason_id = 'Txn is already reported' GROUP BY 1)"""
SQL["recon_table"] = f"SELECT rpt_grp_id, GROUPING(rpt_grp_id) = 1 AS is_total, {tot(PUB, 'published')}, {tot(SRC, 'expected')}, {tot(TGT, 'matched')}, {tot(MIS, 'missed')} FROM lr GROUP BY ROLLUP (rpt_grp_id)"
SQL["group_breakdown"] = f"""SELECT *, {pct('reported', 'requires_reporting')} AS reported_pct FROM (
    SELECT rpt_grp_id, GROUPING(rpt_grp_id) = 1 AS is_total, {cohort('total_rule_hits excluded requires_reporting reported still_open')}, {cnt(f'{OPEN} AND {AGE} > 30', 'open_over_30_days')}
    FROM cohort_hits GROUP BY ROLLUP (rpt_grp_id))"""
_BAND = f"CASE {' '.join(f'WHEN {c} THEN {chr(39)}{n}{chr(39)}' for n, c in _BANDS.items())} END"
SQL["open_hits_drill"] = f"""SELECT rpt_grp_id, rpt_grp_name, bucket_id, rule_id, attempt_id, external_txn_key, galactic_id, mtcn, source, transaction_side, transaction_date,
    rule_currency_amount, rule_iso_currency_code, age::INT AS age_days, {_BAND} AS age_band FROM backlog"""
SQL["open_hits_drill__page"] = SQL["open_hits_drill"] + " WHERE age > 30 AND source = 'TARGET' ORDER BY transaction_date, external_txn_key, rpt_grp_id, rule_id, attempt_id, bucket_id LIMIT 100"
SQL["export_open_hits"] = SQL["open_hits_drill"]
_TIED = ("total_rule_hits", "excluded", "requires_reporting", "reported", "still_open", "open_over_30_days")
_COUNTED = f"SELECT {cohort('total_rule_hits excluded requires_reporting reported still_open')}, {cnt(f'{OPEN} AND {AGE} > 30', 'open_over_30_days')} FROM cohort_hits"
_SHOWN = [
    f"""SELECT '{kind} {n}' AS "check", (SELECT {n} FROM ({_COUNTED})) AS left_side,
        coalesce((SELECT sum({n}) FROM ({SQL['group_breakdown']}) WHERE {'' if kind == 'total' else 'NOT '}is_total), 0)::BIGINT AS right_side"""
    for kind in ("total", "groups") for n in _TIED
]
_SHOWN.append(f"SELECT 'excluded + reported + open = total', excluded + reported + still_open, total_rule_hits FROM ({_COUNTED})")
SQL["tie_out"] = f"SELECT *, left_side = right_side AS passed FROM ({' UNION ALL '.join(_SHOWN)})"
SQL["kpi_groups"] = f"""SELECT *, {pct('matched_rule_hits', 'expected_rule_hits')} AS match_rate_pct FROM (
    SELECT count(*) AS batches_run, count(DISTINCT rpt_grp_id) AS report_groups_run, {cnt(ISSUE, 'batches_with_issues')},
        {cnt(f"{LEVEL} IN ('Critical', 'Failed')", 'critical_or_failed_batches')}, {tot('txn_missing_attempt_count', 'missing_attempts')},
        {tot('activity_transformation_failed', 'transformation_failures')}, {tot('duplicate_transformation', 'duplicate_transformations')},
        {cnt(RECON, 'reconciliation_issue_batches')}, {cnt(IMBALANCED, 'control_imbalance_batches')} FROM lbi), hit_sums"""
SQL["report_group_health_full"] = f"""SELECT b.*, country_name AS country, coalesce(expected_rule_hits, 0) AS expected_rule_hits,
    coalesce(matched_rule_hits, 0) AS matched_rule_hits, coalesce(missed_rule_hits, 0) AS missed_rule_hits, match_rate_pct
    FROM (SELECT rpt_grp_id, rpt_grp_name, count(*) AS batches_run, {cnt(ISSUE, 'batches_with_issues')}, {tot('txn_missing_attempt_count', 'missing_attempts')},
        {tot('activity_transformation_failed', 'transformation_failures')}, {tot('duplicate_transformation', 'duplicate_transformations')},
        {cnt(RECON, 'reconciliation_issues')},
        ['Healthy', 'Warning', 'In Progress', 'Critical', 'Failed'][max(list_position(['Healthy', 'Warning', 'In Progress', 'Critical', 'Failed'], {LEVEL}))] AS health
        FROM lbi GROUP BY rpt_grp_id, rpt_grp_name) b
    LEFT JOIN (SELECT *, {pct('matched_rule_hits', 'expected_rule_hits')} AS match_rate_pct FROM (SELECT rpt_grp_id, {tot(SRC, 'expected_rule_hits')},
        {tot(TGT, 'matched_rule_hits')}, {tot(MIS, 'missed_rule_hits')} FROM lr GROUP BY rpt_grp_id)) USING (rpt_grp_id)
    LEFT JOIN (SELECT rpt_grp_id, country_name FROM group_config) USING (rpt_grp_id)"""
_ROOM = ", ".join(
    f"{z(SIDES[n][0])} AS {n}_left, {' + '.join(z(x) for x in SIDES[n][1])} AS {n}_right, g_{n} AS {n}_balance"
    for n in ("reportable", "lookback", "reporting_period", "activity", "transformation")
)
SQL["batch_control_room"] = f"""SELECT rpt_grp_id, rpt_grp_name, country_name AS country, batch_id, seq_no, process_timestamp, batch_status, compiler_status, report_status,
    {LEVEL} AS health, {_ROOM}, {z('duplicate_transformation')} AS duplicate_transformations, {z('txn_missing_attempt_count')} AS missing_attempts,
    {z('excluded_txn')} AS excluded_transactions, {z('already_reported_count')} AS already_reported, {z('activity_missing')} AS activity_missing,
    {z('soft_dedup_dropped_txn_count')} AS soft_dedup_dropped
    FROM any_lbi LEFT JOIN (SELECT rpt_grp_id, country_name FROM group_config) USING (rpt_grp_id)"""
SQL["batch_investigation_queue"] = f"""SELECT * FROM (SELECT rpt_grp_id, rpt_grp_name, batch_id, seq_no, {LEVEL} AS health, g_reportable AS reportable_diff,
    g_transformation AS transformation_diff, {z('activity_transformation_failed')} AS transformation_failures, {z('txn_missing_attempt_count')} AS missing_attempts,
    {z('duplicate_transformation')} AS duplicate_transformations, batch_status, compiler_status, report_status, process_timestamp FROM lbi) WHERE health <> 'Healthy'"""
SQL["health_five_level"] = f"SELECT rpt_grp_id, batch_id, {LEVEL} AS health FROM lbi"

# Transformer
_PK = "rpt_grp_id, bucket_id, rule_id, attempt_id"
_SAME = "g.rpt_grp_id = k.rpt_grp_id AND g.key_txn = k.key_txn AND g.key_part IS NOT DISTINCT FROM k.key_part"
SQL["select_rule_hits"] = f"SELECT {_PK} FROM candidates"
SQL["drop_sml"] = f"SELECT {_PK} FROM hits WHERE coalesce(galactic_id NOT LIKE '%SML%', true) AND coalesce(mtcn NOT LIKE '%SML%', true)"
SQL["recon_keys"] = "SELECT rpt_grp_id, key_txn, key_part, count(*) AS row_count FROM keyed GROUP BY ALL"
SQL["key_excluded"] = """SELECT rpt_grp_id, key_txn, key_part, count(*) AS row_count, count(exclusion_reason_id) AS excluded_rows,
    count(*) = count(exclusion_reason_id) AS is_excluded FROM keyed GROUP BY rpt_grp_id, key_txn, key_part"""
SQL["missing_attempts__kept"] = f"SELECT {_PK} FROM keyed k WHERE NOT EXISTS (FROM gone g WHERE {_SAME})"
SQL["missing_attempts__counts"] = "SELECT rpt_grp_id, count(*) AS missing_attempt_keys FROM gone GROUP BY ALL"
SQL["missing_attempts__evidence"] = "SELECT DISTINCT rpt_grp_id, key_txn AS identifier, 'TRANSACTION_JOIN' AS stage, 'ERROR' AS status, 'ATTEMPT_NOT_RECEIVED' AS comments FROM gone"
# Another hit of the key: one with another primary key.
_OTHER = f"FROM keyed g WHERE {_SAME} AND g.is_reported AND (g.rpt_grp_id, g.bucket_id, g.rule_id, g.attempt_id) <> (k.rpt_grp_id, k.bucket_id, k.rule_id, k.attempt_id)"
SQL["already_reported__kept"] = f"SELECT {_PK} FROM candidates k WHERE NOT EXISTS ({_OTHER})"
SQL["already_reported__evidence"] = f"""SELECT DISTINCT rpt_grp_id, key_txn AS identifier, 'FILTRATION' AS stage, 'EXCLUDED' AS status,
    'EXCLUDED_BECAUSE_ALREADY_REPORTED(TARGET)' AS comments FROM candidates k WHERE EXISTS ({_OTHER})"""
SQL["soft_dedup"] = f"SELECT {_PK} FROM candidates QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, key_txn, key_part ORDER BY attempt_id DESC, rule_id DESC, bucket_id DESC) = 1"
SQL["soft_dedup__dropped"] = """SELECT rpt_grp_id, count(*) AS rows_in, count(DISTINCT (key_txn, key_part)) AS rows_kept,
    count(*) - count(DISTINCT (key_txn, key_part)) AS soft_dedup_dropped_txn_count FROM candidates GROUP BY rpt_grp_id"""
for _n, _t in (("lookback", "reporting_timestamp >= w0 AND reporting_timestamp < w1"), ("period", "reporting_timestamp BETWEEN w1 AND w2")):
    SQL[f"future_reporting_{_n}"] = f"""SELECT w.rpt_grp_id, w.batch_id, count(*) AS future_reporting_txn FROM windows w JOIN hits h ON h.rpt_grp_id = w.rpt_grp_id
        AND {_t} WHERE created_timestamp::DATE > reporting_timestamp::DATE GROUP BY ALL"""


def i(cond: str, name: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


SQL["build_batch_reconciliation"] = f"""SELECT rpt_grp_id, run AS batch_id, count(*) AS txn_selected, {i('all_ex', 'excluded_txn')},
    {i('n_live > 0 AND no_attempt', 'txn_missing_attempt_count')}, {i('n_live > 0 AND NOT no_attempt AND known', 'already_reported_count')},
    {i('kept', 'expected_reportable_txn')}, {i('kept AND x.t < x.w1', 'lookback_txn')},
    {i('kept AND x.t < x.w1 AND f_look', 'lookback_future_reporting_txn')},
    {i('kept AND x.t < x.w1 AND NOT coalesce(f_look, false)', 'lookback_actual_txn')}, {i('kept AND x.t >= x.w1', 'reporting_period_txn')},
    {i('kept AND x.t >= x.w1 AND f_per', 'reporting_period_future_reporting_txn')},
    {i('kept AND x.t >= x.w1 AND NOT coalesce(f_per, false)', 'reporting_period_actual_txn')}, {i('kept', 'activity_selected')},
    coalesce(sum(n_left - 1) FILTER (kept), 0)::BIGINT AS soft_dedup_dropped_txn_count FROM pool_state GROUP BY rpt_grp_id, run"""
_IN_TXN = f"""SELECT rpt_grp_id, run AS batch_id, key_txn, {i('kept AND x.a IS NULL', 'no_sur')}, {i('kept AND x.a IS NOT NULL', 'ready')}
    FROM pool_state GROUP BY ALL"""
_REACHED = """SELECT rpt_grp_id, batch_id, identifier AS key_txn, max(status IN ('SUCCESS', 'GENERATED')) AS ok,
    max(stage = 'TRANSFORMATION' AND status = 'FAILURE') AS bad FROM journey GROUP BY ALL"""
SQL["build_batch_reconciliation__row"] = f"""SELECT c.*, coalesce(last, 0) + 1 AS seq_no, rpt_grp_name,
    strftime(w0, '%Y-%m-%d') AS rpt_look_back_date, strftime(w1, '%Y-%m-%d') AS rpt_from_date, strftime(w2, '%Y-%m-%d') AS rpt_to_date,
    0 AS txn_simulated, 0 AS activity_simulated, lookback_actual_txn + reporting_period_actual_txn AS actual_reportable_txn,
    activity_missing, eligible AS expected_activity_eligible_for_transformation, good + lost AS actual_activity_eligible_for_transformation,
    good AS activity_transformed, lost AS activity_transformation_failed, again AS duplicate_transformation,
    TIMESTAMP '2002-01-01' AS created_timestamp, TIMESTAMP '2002-01-01' AS modified_timestamp
    FROM ({SQL["build_batch_reconciliation"]}) c
    JOIN (SELECT rpt_grp_id, batch_id, sum(no_sur)::BIGINT AS activity_missing, sum(ready)::BIGINT AS eligible,
            coalesce(sum(ready) FILTER (ok), 0)::BIGINT AS good, coalesce(sum(ready) FILTER (bad AND NOT ok), 0)::BIGINT AS lost,
            coalesce(sum(ready - 1) FILTER (ok AND ready > 1), 0)::BIGINT AS again
          FROM ({_IN_TXN}) LEFT JOIN ({_REACHED}) USING (rpt_grp_id, batch_id, key_txn) GROUP BY ALL) USING (rpt_grp_id, batch_id)
    JOIN windows USING (rpt_grp_id, batch_id) LEFT JOIN (SELECT rpt_grp_id, rpt_grp_name FROM group_config) USING (rpt_grp_id)
    LEFT JOIN (SELECT rpt_grp_id, batch_id, max(seq_no) AS last FROM batch_recon GROUP BY ALL) USING (rpt_grp_id, batch_id)"""
SQL["build_batch_reconciliation__controls"] = f"""SELECT rpt_grp_id, batch_id, seq_no, {', '.join(f'g_{n} AS {n}_diff' for n in SIDES)}
    FROM (SELECT *, {GAPS} FROM ({SQL["build_batch_reconciliation__row"]}))"""
SQL["assign_batch"] = """SELECT * REPLACE (
    if(efile_batch_id IS NULL AND exclusion_reason_id IS NULL, 'E' || strftime(transaction_date, '%Y%m'), efile_batch_id) AS efile_batch_id,
    if(efile_batch_id IS NULL AND exclusion_reason_id IS NULL, false, is_reported) AS is_reported,
    if(efile_batch_id IS NULL AND exclusion_reason_id IS NULL, TIMESTAMP '2002-01-01', modified_timestamp) AS modified_timestamp) FROM hits"""
SQL["upsert_latest"] = "SELECT * FROM batch_info QUALIFY row_number() OVER (PARTITION BY rpt_grp_id, batch_id ORDER BY seq_no DESC) = 1"
SQL["expected_matched_missed"] = """SELECT rpt_grp_id, count(*) AS expected, count(*) FILTER (r) AS matched, count(*) FILTER (NOT r) AS missed
    FROM (SELECT rpt_grp_id, external_txn_key, rule_id, bool_or(coalesce(is_reported, false)) AS r FROM hits GROUP BY ALL) GROUP BY rpt_grp_id"""

# Cases
SQL["case_records"] = """SELECT mtcn, sender_name AS name, sender_country AS country, amount, gsi_match_score AS match_score, 'name|partial DOB' AS matched_fields,
    len(fl)::INT AS flag_count, array_to_string(fl, '|') AS flags, transfers_30d FROM graded"""
SQL["grade_cases"] = "SELECT mtcn, grade, if(grade = 'LOW', 'APPROVE', 'ESCALATE') AS recommendation, 0.6::DOUBLE AS confidence FROM grades"
SQL["risk_indicators"] = """SELECT mtcn, 1 AS position, 'Screening match strength' AS indicator,
        CASE WHEN gsi_match_score >= 0.75 THEN 'high' WHEN gsi_match_score >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
        gsi_list || ' (score ' || gsi_match_score || ')' AS evidence FROM graded
    UNION ALL SELECT mtcn, 2, 'Possible structuring', 'high', [x FOR x IN fl IF regexp_matches(x, 'threshold|structur', 'i')][1]
    FROM graded WHERE regexp_matches(flags, 'threshold|structur', 'i')"""
_DOC = "SELECT mtcn, if(channel = '1-URGENT', 'unknown', grade) AS prior_grade, grade FROM grades WHERE channel IN ('1-URGENT', '2-HIGH')"
_DOCGRADE = "if(prior_grade IN ('LOW', 'MEDIUM', 'HIGH'), prior_grade, 'MEDIUM')"
SQL["regrade_with_document"] = f"""SELECT mtcn, grade, if(grade = 'LOW', 'APPROVE', 'ESCALATE') AS recommendation, 0.6::DOUBLE AS confidence, prior_grade,
    {_DOCGRADE} AS document_grade, 'ESCALATE' AS document_recommendation, 0.6::DOUBLE AS document_confidence, false AS grade_changed FROM ({_DOC})"""
SQL["final_grade"] = f"SELECT mtcn, coalesce(d, grade) AS final_grade FROM grades LEFT JOIN (SELECT mtcn, {_DOCGRADE} AS d FROM ({_DOC})) USING (mtcn)"
SQL["route_documents"] = r"""
    WITH u AS (
        SELECT 'd' || doc_id AS upload_id, 'Report_' || source || ' (' || lang || ').' ||
               CASE lang WHEN 'de' THEN 'PDF' WHEN 'fr' THEN 'jpg' WHEN 'es' THEN 'scan' ELSE 'txt' END AS filename,
               CASE lang WHEN 'es' THEN 'image/tiff' WHEN 'en' THEN 'text/plain' END AS content_type, text FROM documents
        UNION ALL SELECT 'p' || page_id, url, 'text/html', html FROM pages),
    e AS (SELECT *, regexp_extract(lower(filename), '\.([a-z0-9]+)$', 1) AS ext FROM u),
    r AS (SELECT *, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN content_type LIKE 'image/%' OR ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp') THEN 'image' ELSE 'text' END AS route FROM e),
    b AS (SELECT *, unnest(CASE WHEN route = 'text' THEN range(greatest(1, ceil(length(text) / 20000.0)::BIGINT)) ELSE [0] END)::INT AS block_no FROM r)
    SELECT upload_id, filename, content_type, route,
           CASE route WHEN 'pdf' THEN 'pdf' WHEN 'image' THEN CASE WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext IN ('png', 'gif', 'webp') THEN ext ELSE 'png' END END AS format,
           coalesce(nullif(left(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[^a-zA-Z0-9 \-\(\)\[\]]', '-', 'g'), 60), ''), 'document') AS safe_name,
           block_no, if(route = 'text', substr(text, block_no::BIGINT * 20000 + 1, 20000), NULL) AS block FROM b"""
_WHY = """CASE WHEN channel = '5-LOW' AND receiver_country = receiver_country THEN 'cut' WHEN receiver_country = 'ASIA' THEN 'grade'
    WHEN receiver_country = 'EUROPE' THEN 'recommendation' WHEN receiver_country = 'AFRICA' THEN 'severity' END"""
SQL["parse_model_outputs"] = f"""SELECT mtcn, 'HIGH' AS grade, 'ESCALATE' AS recommendation, 0.5::DOUBLE AS confidence, sender_name AS rationale, 'low' AS severity
    FROM cases_flat WHERE {_WHY} IS NULL"""
SQL["parse_model_outputs__quarantine"] = f"SELECT mtcn, if({_WHY} = 'cut', 'schema', {_WHY}) AS reason FROM cases_flat WHERE {_WHY} IS NOT NULL"
SQL["parse_model_outputs__documents"] = """SELECT mtcn, 'de' AS detected_language, sender_name AS document_summary, 'LOW' AS grade,
    0.75::DOUBLE AS confidence, false AS grade_changed FROM cases_flat WHERE channel = '1-URGENT' AND sender_name IS NOT NULL AND receiver_country IS NOT NULL"""
SQL["parse_model_outputs__documents_quarantine"] = """SELECT mtcn, if(channel = '5-LOW' AND sender_name IS NOT NULL AND receiver_country IS NOT NULL, 'severity', 'schema') AS reason
    FROM cases_flat WHERE channel <> '1-URGENT' OR sender_name IS NULL OR receiver_country IS NULL"""
SQL["decisions"] = """SELECT mtcn, action, grade, decided_at FROM (
        SELECT split_part(case_id, '-', 1) AS mtcn, CASE to_status WHEN 'complete' THEN 'APPROVED' WHEN 'error' THEN 'DENIED' END AS action,
               if(value > 20, 'HIGH', 'LOW') AS grade, ts AS decided_at, event_id FROM case_events)
    WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mtcn ORDER BY decided_at DESC, event_id DESC) = 1"""
SQL["threshold_structuring"] = """SELECT sender_id, sent_on, txn_id, amount, count(*) OVER w AS transfers_30d, (sum(amount) OVER w)::DECIMAL(38,2) AS total_30d,
    sum(if(amount < 250000 AND amount >= 200000, 1, 0)) OVER w::BIGINT AS just_under_limit,
    (sum(amount) OVER w)::DOUBLE / count(*) OVER w AS avg_amount FROM transfers
    WINDOW w AS (PARTITION BY sender_id ORDER BY sent_on RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""".replace(
    "sum(if(amount < 250000 AND amount >= 200000, 1, 0)) OVER w::BIGINT", "(sum(if(amount < 250000 AND amount >= 200000, 1, 0)) OVER w)::BIGINT"
)

# Lifecycle
SQL["case_status_view"] = """SELECT c.case_id, status, if(status IN ('complete', 'error'), NULL, status) AS current_stage, coalesce(done, '') AS completed_stages,
    failed_stage, error_reason FROM cases c LEFT JOIN (
        SELECT case_id, string_agg(stage, ',' ORDER BY list_position(['retrieving', 'analyzing', 'doc_analysis'], stage)) AS done FROM first_results GROUP BY ALL) USING (case_id)"""
SQL["case_summary_view"] = """SELECT case_id, status, max(output) FILTER (stage = 'retrieving') AS retrieving_output, max(output) FILTER (stage = 'analyzing') AS analyzing_output,
    max(output) FILTER (stage = 'doc_analysis') AS doc_analysis_output, status = 'error' AS is_partial
    FROM cases LEFT JOIN first_results USING (case_id) WHERE status IN ('complete', 'error') GROUP BY case_id, status"""
SQL["list_cases"] = "SELECT case_id, owner_sub, status, created_at FROM cases ORDER BY created_at DESC, case_id DESC LIMIT 50"
SQL["list_cases__next"] = "SELECT case_id, owner_sub, status, created_at FROM cases WHERE (created_at, case_id) < (TIMESTAMP '2024-01-10', '5-5') ORDER BY created_at DESC, case_id DESC LIMIT 20"
SQL["list_cases__owner"] = "SELECT case_id, owner_sub, status, created_at FROM cases WHERE owner_sub = 'u7' ORDER BY created_at DESC, case_id DESC LIMIT 10"
SQL["list_cases__cursor"] = f"SELECT created_at, case_id FROM ({SQL['list_cases']}) ORDER BY created_at, case_id LIMIT 1"
SQL["dedupe_submissions"] = """SELECT idempotency_key, arg_min(case_id, (created_at, event_id)) AS case_id, arg_min(owner_sub, (created_at, event_id)) AS owner_sub,
    min(created_at) AS created_at, count(*) AS submissions FROM submissions GROUP BY idempotency_key"""
SQL["claim_cases"] = "SELECT case_id, arg_min(worker, (claimed_at, event_id)) AS claimed_by, min(claimed_at) AS claimed_at, count(*) - 1 AS lost_claims FROM claims GROUP BY case_id"
SQL["idempotent_stages"] = "SELECT * FROM first_results"
SQL["guarded_transitions"] = """SELECT case_id, f.s AS status, if(f.s = 'error', f.was, NULL) AS failed_stage, f.n::BIGINT AS accepted, events - f.n AS dropped, f.t AS changed_at FROM folded"""
SQL["reap_stuck"] = """SELECT case_id, owner_sub, 'error' AS status, status AS failed_stage, 'TIMEOUT' AS error_reason, coalesce(claimed_at, created_at) AS since
    FROM cases WHERE cases.status NOT IN ('complete', 'error') AND coalesce(claimed_at, created_at) < TIMESTAMP '2024-01-24 23:45:00'"""
SQL["active_case_cap"] = "SELECT owner_sub, count(*) AS active_cases FROM cases WHERE status NOT IN ('complete', 'error') GROUP BY owner_sub HAVING count(*) >= 5"
SQL["lifecycle_metrics"] = f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS events,
    {', '.join(cnt(f"to_status = '{s}'", s) for s in ('retrieving', 'analyzing', 'doc_analysis', 'complete', 'error'))} FROM case_events GROUP BY 1"""
SQL["stream_lifecycle_metrics"] = SQL["lifecycle_metrics"]
SQL["lifecycle_metrics"] = f"""SELECT coalesce(e.window_start, c.window_start) AS window_start, coalesce(events, 0) AS events, coalesce(created, 0) AS created,
    {', '.join(f'coalesce({s}, 0) AS {s}' for s in ('retrieving', 'analyzing', 'doc_analysis', 'complete', 'error'))}
    FROM ({SQL['lifecycle_metrics']}) e FULL JOIN (SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start, count(*) AS created
        FROM (SELECT min(created_at) AS created_at FROM submissions GROUP BY idempotency_key) GROUP BY 1) c USING (window_start)"""
SQL["stage_durations"] = """SELECT stage, count(*) AS cases, round(quantile_cont(seconds, 0.5), 6) AS median_seconds, round(quantile_cont(seconds, 0.95), 6) AS p95_seconds FROM (
    SELECT b.stage, trunc(epoch_us(b.completed_at - a.completed_at) / 1e6)::DOUBLE AS seconds FROM first_results a JOIN first_results b USING (case_id)
    WHERE (a.stage, b.stage) IN (('retrieving', 'analyzing'), ('analyzing', 'doc_analysis'))) WHERE seconds >= 0 GROUP BY stage"""
SQL["poll_rate"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS polls, count(DISTINCT case_id) AS cases FROM case_events GROUP BY 1"
SQL["silent_sessions"] = """SELECT case_id, min(ts) AS started_at, min(ts) FILTER (to_status IN ('complete', 'error')) AS ended_at FROM case_events GROUP BY case_id
    HAVING min(ts) + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-25' AND (ended_at IS NULL OR ended_at > min(ts) + INTERVAL 10 MINUTE)"""
SQL["assemble_stream"] = """SELECT session_id, ((entry_id - 1) // 5000)::BIGINT AS part_no, string_agg(data, '' ORDER BY entry_id) AS text, count(*) AS chunks,
    coalesce(max(status), 'streaming') AS status FROM stream_entries LEFT JOIN stream_ends USING (session_id)
    WHERE type = 'chunk' AND (end_id IS NULL OR entry_id < end_id) GROUP BY ALL"""
SQL["resume_from"] = "SELECT * FROM stream_entries WHERE entry_id > 3"
SQL["expire_streams"] = """SELECT e.* FROM stream_entries e JOIN (SELECT session_id, min(ts) AS t0 FROM stream_entries GROUP BY ALL) USING (session_id)
    LEFT JOIN stream_ends USING (session_id) WHERE TIMESTAMP '2024-01-01 12:30:00' < t0 + INTERVAL 24 HOUR
    AND (type <> 'chunk' OR ended_at IS NULL OR TIMESTAMP '2024-01-01 12:30:00' < ended_at + INTERVAL 15 MINUTE)"""
SQL["open_sessions"] = """SELECT session_id, count(*) AS entries, max(ts) AS last_ts, coalesce(any_value(status), 'streaming') AS status
    FROM stream_entries LEFT JOIN stream_ends USING (session_id) GROUP BY session_id"""

# Streaming forms give what their batch forms give
SQL["stream_dedupe_submissions"] = "SELECT idempotency_key, arg_min(case_id, (created_at, event_id)) AS case_id, min(created_at) AS created_at FROM submissions GROUP BY 1"
SQL["stream_idempotent_stages"] = SQL["idempotent_stages"]
SQL["stream_guarded_transitions"] = "SELECT case_id, f.s AS status, f.n::BIGINT AS accepted, events - f.n AS dropped FROM folded"

# No end within 15 minutes of the first event, and the newest event is a minute past that.
SQL["stream_reap_stuck"] = """SELECT case_id, 'error' AS status, arg_max(to_status, (ts, event_id)) AS failed_stage, 'TIMEOUT' AS error_reason, min(t0) AS since
    FROM case_events JOIN (SELECT case_id, min(ts) AS t0 FROM case_events GROUP BY 1) USING (case_id) WHERE ts <= t0 + INTERVAL 15 MINUTE
    GROUP BY case_id HAVING count(*) FILTER (to_status IN ('complete', 'error')) = 0
    AND min(t0) + INTERVAL 15 MINUTE < (SELECT max(ts) - INTERVAL 1 MINUTE FROM case_events)"""
SQL["stream_sessions"] = """SELECT case_id, min(ts) AS started_at, max(ts) + INTERVAL 10 MINUTE AS closed_at, count(*) AS events,
    count(*) FILTER (to_status IN ('complete', 'error')) AS terminal_events FROM (
        SELECT *, sum(if(pause < INTERVAL 10 MINUTE, 0, 1)) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS burst FROM (
            SELECT *, ts - lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pause FROM case_events))
    GROUP BY case_id, burst"""


def oracle() -> dict[str, str]:
    return {name: with_tables(sql, STEPS) for name, sql in SQL.items()}
