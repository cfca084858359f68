"""Schemas and readers of the operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Table layouts. Columns that carry the name of the system that produced
# them use the neutral endings _source (publishes the hits) and _target (reports them);
# see with_neutral_names. Counters are BIGINT: one batch may hold more hits than an INT can count.
SCHEMAS: dict[str, str] = {
    "rule_hit": """rpt_grp_id INT, bucket_id INT, rule_id STRING, attempt_id BIGINT, activity_type STRING,
        batch_id INT, created_timestamp TIMESTAMP, efile_batch_id STRING, exclusion_reason_id STRING,
        external_txn_key BIGINT, galactic_id STRING, is_reported BOOLEAN, modified_timestamp TIMESTAMP,
        mtcn STRING, objective_aggregation_key STRING, reporting_timestamp TIMESTAMP, rpt_grp_name STRING,
        rule_currency_amount DECIMAL(18,2), rule_iso_currency_code STRING, send_date DATE, source STRING,
        transaction_date TIMESTAMP, transaction_side STRING, reported_batch_id STRING""",
    "rule_hit_reconciliation": """rpt_grp_id INT, run_date INT, seq_no INT, created_timestamp TIMESTAMP,
        data_selection_end_date TIMESTAMP, data_selection_start_date TIMESTAMP,
        distinct_rule_hits_count_source BIGINT, distinct_rule_hits_count_target BIGINT,
        missed_rule_hits_count_target BIGINT, modified_timestamp TIMESTAMP, rpt_grp_name STRING,
        rule_hit_publish_count_source BIGINT""",
    "rule_hit_exclusion_audit": """attempt_id BIGINT, rpt_grp_id INT, rule_id STRING, bucket_id INT,
        rpt_grp_name STRING, external_txn_key BIGINT, processing_batch_id STRING, exclusion_reason_id STRING,
        exclusion_strategy STRING, reported_batch_id STRING, mtcn STRING, created_timestamp TIMESTAMP,
        modified_timestamp TIMESTAMP, reporting_timestamp TIMESTAMP""",
    "record_transformation_journey": """rpt_grp_id INT, batch_id STRING, identifier STRING, mtcn STRING,
        stage STRING, status STRING, comments STRING, created_timestamp TIMESTAMP,
        modified_timestamp TIMESTAMP, reporting_timestamp_latest TIMESTAMP, processing_complete BOOLEAN,
        txn_metadata STRING, skip_reason STRING""",
    "report_transformation_reconciliation": """batch_id STRING, seq_no INT, rpt_grp_id INT,
        rpt_grp_name STRING, rpt_look_back_date STRING, rpt_from_date STRING, rpt_to_date STRING,
        txn_selected BIGINT, txn_simulated BIGINT, excluded_txn BIGINT, txn_missing_attempt_count BIGINT,
        already_reported_count BIGINT, expected_reportable_txn BIGINT, actual_reportable_txn BIGINT, lookback_txn BIGINT,
        lookback_future_reporting_txn BIGINT, lookback_actual_txn BIGINT, reporting_period_txn BIGINT,
        reporting_period_future_reporting_txn BIGINT, reporting_period_actual_txn BIGINT, activity_selected BIGINT,
        activity_missing BIGINT, activity_simulated BIGINT, expected_activity_eligible_for_transformation BIGINT,
        actual_activity_eligible_for_transformation BIGINT, activity_transformed BIGINT,
        activity_transformation_failed BIGINT, duplicate_transformation BIGINT, created_timestamp TIMESTAMP,
        modified_timestamp TIMESTAMP, soft_dedup_dropped_txn_count BIGINT""",
    "report_batch_info": """rpt_grp_id INT, batch_id STRING, seq_no INT, process_timestamp TIMESTAMP,
        created_timestamp TIMESTAMP, batch_status STRING, compiler_status STRING, report_status STRING,
        txn_lookback_start_timestamp TIMESTAMP, txn_start_timestamp TIMESTAMP, txn_end_timestamp TIMESTAMP""",
    "report_group_config": """rpt_grp_id INT, rpt_grp_name STRING, country_name STRING,
        rpt_config_active_flag BOOLEAN, inbound_rule_id STRING, outbound_rule_id STRING,
        reconciliation_strategy_metadata STRING""",
    "rule_hit_reconciliation_analysis": """run_date INT, seq_no INT, rpt_grp_id INT, txn_sur_key STRING,
        rule_id STRING, attempt_id BIGINT, created_timestamp TIMESTAMP, description STRING,
        modified_timestamp TIMESTAMP, mtcn STRING, rpt_grp_name STRING""",
    "rule_hit_reconciliation_log": """run_date INT, seq_no INT, rpt_grp_id INT, external_txn_key STRING,
        rule_id STRING, attempt_id BIGINT, mtcn STRING, exclusion_reason_id STRING, is_reported BOOLEAN,
        is_processed BOOLEAN, retry_count INT, status STRING, data_source STRING,
        future_reporting_date TIMESTAMP, created_timestamp TIMESTAMP""",
    "unprocessed_rule_hits": """rpt_grp_id INT, rule_id STRING, attempt_id BIGINT, external_txn_key BIGINT,
        mtcn STRING, exclusion_reason_id STRING, is_reported BOOLEAN, retry_count INT, status STRING,
        data_source STRING, correlation_id STRING, future_reporting_date TIMESTAMP,
        created_timestamp TIMESTAMP""",
    "attempts_by_surrogate_key": "attempt_id BIGINT, txn_sur_key STRING",
    "cases_flat": """mtcn STRING, sender_name STRING, sender_country STRING, sender_id_type STRING,
        receiver_name STRING, receiver_country STRING, receiver_id_type STRING, amount DOUBLE,
        currency STRING, corridor STRING, channel STRING, gsi_list STRING, gsi_matched_name STRING,
        gsi_match_score DOUBLE, gsi_matched_fields STRING, transfers_30d INT, total_30d_usd DOUBLE,
        avg_amount_usd DOUBLE, flags STRING""",
    "cases": """case_id STRING, owner_sub STRING, status STRING, failed_stage STRING, error_reason STRING,
        idempotency_key STRING, claimed_by STRING, claimed_at TIMESTAMP, input STRING, created_at TIMESTAMP,
        updated_at TIMESTAMP""",
    "stage_results": "case_id STRING, stage STRING, output STRING, completed_at TIMESTAMP",
    "stream_entries": "session_id STRING, entry_id BIGINT, type STRING, data STRING, ts TIMESTAMP",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def read_table(
    spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read a table from files. Text formats take the declared schema, never an inferred one."""
    reader = spark.read.format(fmt).options(**options)
    if name is not None and fmt in ("csv", "json"):
        reader = reader.schema(schema(name))
    return reader.load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Read a database table in parallel ranges of a numeric, date or timestamp column.

    The bounds only place the range borders; rows outside them are read too.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def with_neutral_names(df: DataFrame, source_suffix: str, target_suffix: str) -> DataFrame:
    """Rename the columns that end in a system's name to the neutral endings.

    ``with_neutral_names(df, "crm", "ledger")`` turns ``missed_rule_hits_count_ledger``
    into ``missed_rule_hits_count_target``.
    """
    endings = {f"_{source_suffix}": "_source", f"_{target_suffix}": "_target"}
    renamed = {}
    for name in df.columns:
        for old, new in endings.items():
            if "_count_" in name and name.endswith(old):
                renamed[name] = name[: -len(old)] + new
    return df.withColumnsRenamed(renamed)


def check_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value lies outside a closed set (null is allowed)."""
    return df.filter(~F.col(column).isin(*allowed))


# Content types by file ending, for uploads that come without one.
CONTENT_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "txt": "text/plain",
}


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files as rows of filename, content_type and text.

    Bytes that are no UTF-8 are replaced, as a lenient decoder does; pdf and image bytes
    are not turned into text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    typed = files.select(name.alias("filename"), types[ending].alias("content_type"), "content")
    is_text = F.coalesce(F.col("content_type").startswith("text/"), F.lit(True))
    text = F.when(is_text, F.make_valid_utf8(F.col("content").cast("string")))
    return typed.select("filename", "content_type", text.alias("text"))
