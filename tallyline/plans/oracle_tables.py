"""DuckDB statements for the derived tables, written apart from the Spark plans.

``with_tables`` puts the tables a statement names in front of it.
"""

from __future__ import annotations

import re

# Each statement may name tables above it; keys in natural build order.
TABLES: dict[str, str] = {
    "order_parties": """
        SELECT * FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "hit_base": """
        WITH ln AS (
            SELECT l_orderkey AS ok, l_linenumber AS no, max(l_returnflag) AS rf, max(l_linestatus) AS ls,
                   max(l_extendedprice) AS price, max(l_quantity) AS x_qty, max(l_discount) AS x_disc,
                   min(l_tax) AS x_tax
            FROM lineitem GROUP BY ALL)
        SELECT (100 + c_nationkey)::INT AS rpt_grp_id, (ok % 16)::INT AS bucket_id, 'R' || no AS rule_id,
               ok * 10 + no AS attempt_id, c_mktsegment AS activity_type, (ok % 97)::INT AS batch_id,
               (o_orderdate::DATE + (ok % 20)::INT)::TIMESTAMP + INTERVAL 6 HOUR AS created_timestamp,
               CASE WHEN rf IN ('A', 'N') AND NOT o_orderpriority = '5-LOW'
                    THEN 'B' || strftime(o_orderdate, '%Y%m') END AS efile_batch_id,
               CASE WHEN rf || ls = 'RF' THEN 'Txn is already reported'
                    WHEN rf || ls = 'RO' THEN 'Transaction Cancelled' END AS exclusion_reason_id,
               ok AS external_txn_key,
               if(c_acctbal < 0, NULL, 'G' || ok) AS galactic_id,
               CASE WHEN ls = 'F' THEN true WHEN rf = 'N' THEN false END AS is_reported,
               (o_orderdate::DATE + (ok % 20)::INT + 1)::TIMESTAMP + INTERVAL 6 HOUR AS modified_timestamp,
               if(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT', 'SML', 'MTCN') || ok AS mtcn,
               'K' || o_custkey AS objective_aggregation_key,
               if(ls = 'F', (o_orderdate::DATE + ((ok + no) % 45)::INT)::TIMESTAMP, NULL) AS reporting_timestamp,
               n_name AS rpt_grp_name, price::DECIMAL(18,2) AS rule_currency_amount,
               ['USD', 'EUR', 'GBP', 'JPY', 'MXN'][(c_nationkey % 5 + 1)::INT] AS rule_iso_currency_code,
               o_orderdate::DATE AS send_date, if(o_orderstatus = 'F', 'SOURCE', 'TARGET') AS source,
               o_orderdate::TIMESTAMP AS transaction_date,
               if(no % 2 = 0, 'IN', 'OUT') AS transaction_side,
               if(rf || ls = 'RF', 'B' || strftime(o_orderdate, '%Y%m') || if(x_qty > 45, '', '-R'), NULL) AS reported_batch_id,
               x_qty, x_disc, x_tax, r_name AS x_region,
               (year(o_orderdate) * 100 + month(o_orderdate))::INT AS x_ym
        FROM ln JOIN order_parties ON ok = o_orderkey""",
    "hits": "SELECT * EXCLUDE (x_qty, x_disc, x_tax, x_region, x_ym) FROM hit_base",
    "batch_recon": """
        WITH b AS (
            SELECT x_ym, rpt_grp_id, rpt_grp_name, min(transaction_date) AS mn, max(transaction_date) AS mx,
                   count(*) AS sel, count(exclusion_reason_id) AS excl,
                   count(*) FILTER (exclusion_reason_id = 'Txn is already reported') AS already,
                   count(*) FILTER (exclusion_reason_id IS NULL AND x_tax = 0) AS miss,
                   count(*) FILTER (exclusion_reason_id IS NULL AND x_disc <= 0.01) AS fail,
                   count(*) FILTER (x_qty >= 49) AS dup, count(*) FILTER (bucket_id < 4) AS lb,
                   count(*) FILTER (bucket_id >= 4) AS per, count(*) FILTER (bucket_id >= 14) AS fut,
                   x_ym + rpt_grp_id AS h
            FROM hit_base GROUP BY ALL),
        s AS (SELECT *, unnest(if(fail >= miss, [1, 2], [1]))::INT AS seq_no FROM b)
        SELECT 'B' || x_ym AS batch_id, seq_no, rpt_grp_id, rpt_grp_name,
               strftime(mn::DATE - 7, '%Y-%m-%d') AS rpt_look_back_date, strftime(mn, '%Y-%m-%d') AS rpt_from_date,
               strftime(mx, '%Y-%m-%d') AS rpt_to_date, sel AS txn_selected,
               CASE WHEN h % 6 > 0 THEN 0 END::BIGINT AS txn_simulated, excl AS excluded_txn,
               miss AS txn_missing_attempt_count, already AS already_reported_count,
               sel - excl AS expected_reportable_txn,
               if(h % 37 = 0, NULL, sel - excl - CASE WHEN seq_no = 1 THEN 2 WHEN h % 7 = 0 THEN 1 ELSE 0 END) AS actual_reportable_txn,
               lb AS lookback_txn, CASE WHEN h % 4 > 0 THEN 0 END::BIGINT AS lookback_future_reporting_txn,
               lb - if(h % 17 = 0, 1, 0) AS lookback_actual_txn, per AS reporting_period_txn,
               fut AS reporting_period_future_reporting_txn,
               per - fut + if(h % 19 = 0, 1, 0) AS reporting_period_actual_txn,
               lb + per - if(h % 23 = 0, 3, 0) AS activity_selected, 0::BIGINT AS activity_missing, 0::BIGINT AS activity_simulated,
               sel - excl AS expected_activity_eligible_for_transformation,
               sel - excl - if(h % 11 = 0, 1, 0) AS actual_activity_eligible_for_transformation,
               sel - excl - fail AS activity_transformed, fail AS activity_transformation_failed,
               if(h % 5 = 0, dup, NULL) AS duplicate_transformation, mx + INTERVAL 1 DAY AS created_timestamp,
               if(h % 13 = 0, NULL, mx + INTERVAL 2 DAY) AS modified_timestamp, dup AS soft_dedup_dropped_txn_count
        FROM s""",
    "hit_recon": """
        WITH b AS (
            SELECT x_ym, rpt_grp_id, rpt_grp_name, min(transaction_date) AS mn, max(transaction_date) AS mx,
                   count(*) AS n, count(*) FILTER (is_reported) AS rep FROM hit_base GROUP BY ALL)
        SELECT rpt_grp_id, x_ym * 100 + 28 AS run_date, unnest(if(rep * 2 < n, [1, 2], [1]))::INT AS seq_no,
               mx + INTERVAL 3 DAY AS created_timestamp, mx AS data_selection_end_date,
               mn AS data_selection_start_date, n AS distinct_rule_hits_count_source,
               rep - if(rep > 0 AND seq_no = 1, 1, 0) AS distinct_rule_hits_count_target,
               n - rep AS missed_rule_hits_count_target, mx + INTERVAL 4 DAY AS modified_timestamp, rpt_grp_name,
               n + rpt_grp_id % 3 AS rule_hit_publish_count_source
        FROM b""",
    "audit": """
        SELECT attempt_id, rpt_grp_id, rule_id, bucket_id, rpt_grp_name, external_txn_key,
               'B' || x_ym AS processing_batch_id, exclusion_reason_id,
               'TRANSACTION_' || if(bucket_id % 2 = 0, 'ONCE', 'PER_RULE') AS exclusion_strategy,
               reported_batch_id, mtcn, created_timestamp, modified_timestamp, reporting_timestamp
        FROM hit_base WHERE exclusion_reason_id IS NOT NULL AND activity_type <> 'AUTOMOBILE'""",
    "journey": """
        WITH t AS (
            SELECT rpt_grp_id, 'B' || x_ym AS batch_id, external_txn_key::VARCHAR AS identifier, max(mtcn) AS mtcn,
                   max(created_timestamp) AS created_timestamp, max(reporting_timestamp) AS reporting_timestamp_latest,
                   max(CASE exclusion_reason_id WHEN 'Txn is already reported' THEN 4 WHEN 'Transaction Cancelled' THEN 3
                       ELSE CASE WHEN x_tax = 0 THEN 2 WHEN x_disc <= 0.01 THEN 1 ELSE 0 END END) AS k,
                   bool_and(coalesce(is_reported, false)) AS done, max(x_qty) AS q
            FROM hit_base WHERE x_region <> 'MIDDLE EAST' GROUP BY ALL)
        SELECT rpt_grp_id, batch_id, identifier, mtcn,
               CASE WHEN k > 2 THEN 'FILTRATION' WHEN k = 2 THEN 'TRANSACTION_JOIN' WHEN done AND k = 0 THEN 'REPORT_GENERATION'
                    ELSE 'TRANSFORMATION' END AS stage,
               CASE WHEN k > 2 THEN 'EXCLUDED' WHEN k = 2 THEN 'ERROR' WHEN k = 1 THEN 'FAILURE' WHEN done THEN 'GENERATED'
                    ELSE 'SUCCESS' END AS status,
               CASE k WHEN 4 THEN 'EXCLUDED_BECAUSE_ALREADY_REPORTED(TARGET)' WHEN 2 THEN 'ATTEMPT_NOT_RECEIVED'
                    WHEN 1 THEN 'TRANSFORMATION_SKIPPED' END AS comments,
               created_timestamp, created_timestamp + INTERVAL 1 DAY AS modified_timestamp,
               reporting_timestamp_latest, k <> 2 AS processing_complete,
               if(q >= 50, '{"txn_sur_key":"' || identifier || '"}', '{}') AS txn_metadata,
               if(k = 2, 'Attempt ' || identifier || ' not yet recorded', NULL) AS skip_reason
        FROM t""",
    "batch_info": """
        SELECT rpt_grp_id, batch_id, seq_no, created_timestamp + INTERVAL 2 HOUR AS process_timestamp, created_timestamp,
               CASE WHEN txn_selected % 5 = 0 THEN 'Failed' WHEN txn_selected % 7 = 0 THEN 'In Progress' ELSE 'Generated' END AS batch_status,
               CASE WHEN txn_selected % 5 = 0 THEN 'Data Transformation Failed' WHEN txn_selected % 11 <> 0 THEN 'Report Generation Completed' END AS compiler_status,
               CASE WHEN txn_selected % 5 = 0 THEN 'FAILED' WHEN txn_selected % 3 = 0 THEN 'PARTIAL' ELSE 'ALL' END AS report_status,
               rpt_look_back_date::TIMESTAMP AS txn_lookback_start_timestamp, rpt_from_date::TIMESTAMP AS txn_start_timestamp,
               rpt_to_date::TIMESTAMP AS txn_end_timestamp
        FROM batch_recon WHERE soft_dedup_dropped_txn_count <> 0""",
    "group_config": """
        SELECT (100 + n_nationkey)::INT AS rpt_grp_id, n_name AS rpt_grp_name, r_name AS country_name,
               n_nationkey <> 24 AS rpt_config_active_flag, 'R2' AS inbound_rule_id, 'R1' AS outbound_rule_id,
               ['TRANSACTION_ONCE', 'TRANSACTION_PER_RULE', 'INTRA_COUNTRY', 'SOMETHING_ELSE', NULL][n_regionkey + 1] AS reconciliation_strategy_metadata
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "attempts": "SELECT attempt_id, external_txn_key::VARCHAR AS txn_sur_key FROM hit_base WHERE x_tax <> 0",
    "recon_log": """
        SELECT x_ym * 100 + 28 AS run_date, 1 AS seq_no, rpt_grp_id, external_txn_key::VARCHAR AS external_txn_key,
               rule_id, attempt_id, mtcn, exclusion_reason_id, is_reported,
               CASE activity_type WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN NULL ELSE false END AS is_processed,
               bucket_id AS retry_count,
               CASE activity_type WHEN 'BUILDING' THEN 'DONE' WHEN 'FURNITURE' THEN 'RETRY' END AS status,
               source AS data_source, if(bucket_id > 13, created_timestamp + INTERVAL 30 DAY, NULL) AS future_reporting_date,
               created_timestamp
        FROM hit_base WHERE is_reported IS DISTINCT FROM true AND source = 'TARGET'""",
    "recon_analysis": """
        SELECT x_ym * 100 + 28 AS run_date, 1 AS seq_no, rpt_grp_id, external_txn_key::VARCHAR AS txn_sur_key, rule_id,
               attempt_id, created_timestamp,
               CASE WHEN x_disc > 0.05 THEN 'Hit not published' WHEN x_disc > 0.02 THEN 'Late attempt' END AS description,
               modified_timestamp, mtcn, rpt_grp_name
        FROM hit_base WHERE is_reported = false AND x_tax > 0""",
    "unprocessed": """
        SELECT rpt_grp_id, rule_id, attempt_id, external_txn_key, mtcn, exclusion_reason_id, is_reported,
               bucket_id AS retry_count, CASE WHEN bucket_id < 8 THEN 'NEW' WHEN bucket_id < 14 THEN 'RETRY' END AS status,
               source AS data_source, 'C' || attempt_id AS correlation_id, NULL::TIMESTAMP AS future_reporting_date,
               created_timestamp
        FROM hit_base WHERE is_reported IS DISTINCT FROM true AND x_tax = 0""",
    "cases_flat": """
        SELECT o_orderkey::VARCHAR AS mtcn, c_name AS sender_name, n_name AS sender_country,
               if(c_acctbal < 0, 'Passport', 'National ID') AS sender_id_type, 'Receiver ' || c_mktsegment AS receiver_name,
               r_name AS receiver_country, 'Passport' AS receiver_id_type, o_totalprice AS amount, 'USD' AS currency,
               n_name || ' > ' || r_name AS corridor, o_orderpriority AS channel, 'list ' || (o_orderkey % 4) AS gsi_list,
               'Receiver ' || c_mktsegment AS gsi_matched_name, (o_orderkey % 100)::DOUBLE / 100 AS gsi_match_score,
               'name, partial DOB,' AS gsi_matched_fields, (o_orderkey % 12)::INT AS transfers_30d,
               o_totalprice * 2 AS total_30d_usd, o_totalprice / 2 AS avg_amount_usd,
               CASE o_orderkey % 6 WHEN 0 THEN 'Amounts just under the reporting threshold, new receiver'
                    WHEN 1 THEN 'Consistent monthly pattern, Long-standing relationship' WHEN 2 THEN NULL
                    ELSE 'Other' END AS flags
        FROM order_parties""",
    "transfers": """
        SELECT o_custkey AS sender_id, o_orderkey AS txn_id, o_orderdate::DATE AS sent_on,
               o_totalprice::DECIMAL(18,2) AS amount FROM orders""",
    "case_events": """
        SELECT event_id, ts, 'u' || user_id AS owner_sub, user_id || '-' || (event_id % 10) AS case_id,
               CASE event_type WHEN 'signup' THEN 'retrieving' WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'doc_analysis'
                    WHEN 'purchase' THEN 'complete' ELSE 'error' END AS to_status, value, props
        FROM events""",
    "submissions": """
        SELECT user_id || '-' || (event_id % 10) AS case_id, 'u' || user_id AS owner_sub,
               user_id || ':' || json_extract_string(props, '$.k') AS idempotency_key, event_id, ts AS created_at
        FROM events WHERE event_type = 'signup'""",
    "claims": """
        SELECT case_id, 'w' || (trunc(value * 100)::INT % 5) AS worker, event_id, ts AS claimed_at
        FROM case_events WHERE to_status = 'retrieving'""",
    "stage_results": """
        SELECT case_id, to_status AS stage, props AS output, ts AS completed_at, event_id
        FROM case_events WHERE to_status NOT IN ('complete', 'error')""",
    "cases": """
        SELECT case_id, owner_sub, min(ts) AS created_at, max(ts) AS updated_at,
               arg_max(to_status, (ts, event_id)) AS status, min(ts) FILTER (to_status = 'retrieving') AS claimed_at,
               if(status = 'error', 'analyzing', NULL) AS failed_stage, if(status = 'error', 'STAGE_FAILED', NULL) AS error_reason
        FROM case_events GROUP BY case_id, owner_sub""",
    "stream_entries": """
        WITH d AS (SELECT *, ceil(length(text) / 200.0)::BIGINT AS parts FROM documents WHERE length(text) > 0),
        c AS (SELECT doc_id, unnest(range(1, parts + 1)) AS entry_id, text, 'chunk' AS type FROM d),
        e AS (
            SELECT doc_id, entry_id, type, substr(text, (entry_id - 1) * 200 + 1, 200) AS data FROM c
            UNION ALL
            SELECT doc_id, parts + 1, if(lang = 'de', 'error', 'done'), if(lang = 'de', 'model timeout', NULL)
            FROM d WHERE source NOT IN ('src0', 'src1'))
        SELECT 's' || doc_id AS session_id, entry_id, type, data,
               TIMESTAMP '2024-01-01' + to_minutes((doc_id % 1440)::INT) + to_seconds(entry_id) AS ts
        FROM e""",
}


def _needed(sql: str, known: dict[str, str]) -> set[str]:
    return {name for name in known if re.search(rf"\b{name}\b", sql)}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement, preceded by every derived table it reaches."""
    known = {**TABLES, **(extra or {})}
    need: set[str] = set()
    todo = [sql]
    while todo:
        for name in _needed(todo.pop(), known) - need:
            need.add(name)
            todo.append(known[name])
    heads = [f"{name} AS ({known[name]})" for name in known if name in need]
    return f"WITH {', '.join(heads)} {sql}" if heads else sql
