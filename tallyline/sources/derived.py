"""Operational tables computed from the star-schema test tables.

The test data holds no reconciliation tables, so each one is derived from it by the
DataFrame plans below: orders stand for transactions, their lines for rule hits, the
customer's nation for the report group and the order month for the batch. Nothing is
collected or cached; a query reads the base tables through whichever plans it needs,
and column pruning reaches the scans. Only ``Tables.kept`` writes, for queries that say so.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.sinks import shared_folder
from tallyline.sources.tables import SCHEMAS, schema


# Layouts of the base tables. Declaring them spares every read the job that
# opens files to find out.
BASE: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


# What the tables of rule hits are made of.
HIT_LINE = (
    "l_orderkey l_linenumber rf ls price x_qty x_disc x_tax o_custkey o_orderstatus o_orderdate o_orderpriority "
    "c_nationkey c_acctbal c_mktsegment n_name r_name"
).split()


class Tables:
    """Lazily derived tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE[name]).parquet(f"{self.folder}/{name}.parquet")

    def _columns(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*[f.name for f in schema(name).fields])

    @cached_property
    def order_parties(self) -> DataFrame:
        """Orders with the customer, nation and region they belong to."""
        c = self.base("customer")
        n = self.base("nation")
        r = self.base("region")
        places = n.join(r, n.n_regionkey == r.r_regionkey)
        return (
            self.base("orders")
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def hit_lines(self) -> DataFrame:
        """One row per order line with its order and parties.

        Lines are reduced to their key first: the partial aggregate runs before the
        shuffle, so a hot order is a handful of rows by the time of the join. The one-letter
        flags are aggregated as numbers, since a text maximum would force a sort-based
        aggregate.
        """
        lines = self.base("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.char(F.max(F.ascii("l_returnflag"))).alias("rf"),
            F.char(F.max(F.ascii("l_linestatus"))).alias("ls"),
            F.max("l_extendedprice").alias("price"),
            F.max("l_quantity").alias("x_qty"),
            F.max("l_discount").alias("x_disc"),
            F.min("l_tax").alias("x_tax"),
        )
        return lines.join(self.order_parties, F.col("l_orderkey") == F.col("o_orderkey")).select(*HIT_LINE)

    def kept(self) -> Tables:
        """The same tables, with the joined lines written once under ``spark.checkpoint.dir`` instead of joined anew for each table.

        For queries that take many of them: each keeps other columns, so no shuffle of the lines serves two.
        """
        path = shared_folder(self.spark, "hit-lines")
        self.hit_lines.write.option("compression", "zstd").parquet(path)
        out = Tables(self.spark, self.folder)
        out.hit_lines = self.spark.read.schema(self.hit_lines.schema).parquet(path)
        return out

    @cached_property
    def hit_base(self) -> DataFrame:
        """One row per order line, with columns (x_) that later tables draw faults from."""
        return self.hit_lines.selectExpr(
            "CAST(100 + c_nationkey AS INT) AS rpt_grp_id",
            "CAST(l_orderkey % 16 AS INT) AS bucket_id",
            "concat('R', l_linenumber) AS rule_id",
            "l_orderkey * 10 + l_linenumber AS attempt_id",
            "c_mktsegment AS activity_type",
            "CAST(l_orderkey % 97 AS INT) AS batch_id",
            "CAST(CAST(o_orderdate AS DATE) + CAST(l_orderkey % 20 AS INT) AS TIMESTAMP_NTZ) + INTERVAL '6' HOUR AS created_timestamp",
            "CASE WHEN rf <> 'R' AND o_orderpriority <> '5-LOW' THEN concat('B', date_format(o_orderdate, 'yyyyMM')) END AS efile_batch_id",
            "CASE WHEN rf = 'R' AND ls = 'F' THEN 'Txn is already reported' WHEN rf = 'R' THEN 'Transaction Cancelled' END AS exclusion_reason_id",
            "l_orderkey AS external_txn_key",
            "CASE WHEN c_acctbal >= 0 THEN concat('G', l_orderkey) END AS galactic_id",
            "CASE WHEN ls = 'F' THEN TRUE WHEN rf = 'N' THEN FALSE END AS is_reported",
            "CAST(CAST(o_orderdate AS DATE) + CAST(l_orderkey % 20 + 1 AS INT) AS TIMESTAMP_NTZ) + INTERVAL '6' HOUR AS modified_timestamp",
            "concat(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'SML' ELSE 'MTCN' END, l_orderkey) AS mtcn",
            "concat('K', o_custkey) AS objective_aggregation_key",
            "CASE WHEN ls = 'F' THEN CAST(CAST(o_orderdate AS DATE) + CAST((l_orderkey + l_linenumber) % 45 AS INT) AS TIMESTAMP_NTZ) END AS reporting_timestamp",
            "n_name AS rpt_grp_name",
            "CAST(price AS DECIMAL(18,2)) AS rule_currency_amount",
            "element_at(array('USD', 'EUR', 'GBP', 'JPY', 'MXN'), CAST(c_nationkey % 5 + 1 AS INT)) AS rule_iso_currency_code",
            "CAST(o_orderdate AS DATE) AS send_date",
            "CASE WHEN o_orderstatus = 'F' THEN 'SOURCE' ELSE 'TARGET' END AS source",
            "CAST(o_orderdate AS TIMESTAMP_NTZ) AS transaction_date",
            "CASE WHEN l_linenumber % 2 = 0 THEN 'IN' ELSE 'OUT' END AS transaction_side",
            "CASE WHEN rf = 'R' AND ls = 'F' THEN concat('B', date_format(o_orderdate, 'yyyyMM'), CASE WHEN x_qty > 45 THEN '' ELSE '-R' END) END AS reported_batch_id",
            "x_qty", "x_disc", "x_tax", "r_name AS x_region",
            "year(o_orderdate) * 100 + month(o_orderdate) AS x_ym",
        )

    @cached_property
    def hits(self) -> DataFrame:
        return self._columns(self.hit_base, "rule_hit")

    @cached_property
    def batch_recon(self) -> DataFrame:
        excl = F.col("exclusion_reason_id").isNotNull()
        b = self.hit_base.groupBy("x_ym", "rpt_grp_id", "rpt_grp_name").agg(
            F.min("transaction_date").alias("mn"),
            F.max("transaction_date").alias("mx"),
            F.count("*").alias("sel"),
            F.count_if(excl).alias("excl"),
            F.count_if(F.col("exclusion_reason_id") == "Txn is already reported").alias("already"),
            F.count_if(~excl & (F.col("x_tax") == 0)).alias("miss"),
            F.count_if(~excl & (F.col("x_disc") <= 0.01)).alias("fail"),
            F.count_if(F.col("x_qty") >= 49).alias("dup"),
            F.count_if(F.col("bucket_id") < 4).alias("lb"),
            F.count_if(F.col("bucket_id") >= 4).alias("per"),
            F.count_if(F.col("bucket_id") >= 14).alias("fut"),
        )
        # A batch with at least as many failures as missing attempts was run twice.
        snap = b.withColumn(
            "seq_no", F.explode(F.when(F.col("fail") >= F.col("miss"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        ).withColumn("h", F.col("x_ym") + F.col("rpt_grp_id"))
        out = snap.selectExpr(
            "concat('B', x_ym) AS batch_id", "seq_no", "rpt_grp_id", "rpt_grp_name",
            "CAST(CAST(mn AS DATE) - 7 AS STRING) AS rpt_look_back_date",
            "CAST(CAST(mn AS DATE) AS STRING) AS rpt_from_date",
            "CAST(CAST(mx AS DATE) AS STRING) AS rpt_to_date",
            "sel AS txn_selected",
            "CASE WHEN h % 6 = 0 THEN NULL ELSE 0 END AS txn_simulated",
            "excl AS excluded_txn", "miss AS txn_missing_attempt_count", "already AS already_reported_count",
            "sel - excl AS expected_reportable_txn",
            "CASE WHEN h % 37 = 0 THEN NULL ELSE sel - excl - CASE WHEN seq_no = 1 THEN 2 WHEN h % 7 = 0 THEN 1 ELSE 0 END END AS actual_reportable_txn",
            "lb AS lookback_txn",
            "CASE WHEN h % 4 = 0 THEN NULL ELSE 0 END AS lookback_future_reporting_txn",
            "lb - CASE WHEN h % 17 = 0 THEN 1 ELSE 0 END AS lookback_actual_txn",
            "per AS reporting_period_txn", "fut AS reporting_period_future_reporting_txn",
            "per - fut + CASE WHEN h % 19 = 0 THEN 1 ELSE 0 END AS reporting_period_actual_txn",
            "lb + per - CASE WHEN h % 23 = 0 THEN 3 ELSE 0 END AS activity_selected",
            "0 AS activity_missing", "0 AS activity_simulated",
            "sel - excl AS expected_activity_eligible_for_transformation",
            "sel - excl - CASE WHEN h % 11 = 0 THEN 1 ELSE 0 END AS actual_activity_eligible_for_transformation",
            "sel - excl - fail AS activity_transformed", "fail AS activity_transformation_failed",
            "CASE WHEN h % 5 = 0 THEN dup END AS duplicate_transformation",
            "mx + INTERVAL '1' DAY AS created_timestamp",
            "CASE WHEN h % 13 = 0 THEN NULL ELSE mx + INTERVAL '2' DAY END AS modified_timestamp",
            "dup AS soft_dedup_dropped_txn_count",
        )
        counts = {f.name for f in schema("report_transformation_reconciliation").fields if f.dataType.typeName() == "long"}
        typed = out.withColumns({c: F.col(c).cast("bigint") for c in counts})
        return self._columns(typed, "report_transformation_reconciliation")

    @cached_property
    def hit_recon(self) -> DataFrame:
        b = self.hit_base.groupBy("x_ym", "rpt_grp_id", "rpt_grp_name").agg(
            F.min("transaction_date").alias("mn"),
            F.max("transaction_date").alias("mx"),
            F.count("*").alias("n"),
            F.count_if("is_reported").alias("rep"),
        )
        # Runs that left more than half of the hits open were repeated.
        snap = b.withColumn(
            "seq_no", F.explode(F.when(F.col("rep") * 2 < F.col("n"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        )
        out = snap.selectExpr(
            "rpt_grp_id", "x_ym * 100 + 28 AS run_date", "seq_no",
            "mx + INTERVAL '3' DAY AS created_timestamp",
            "mx AS data_selection_end_date", "mn AS data_selection_start_date",
            "n AS distinct_rule_hits_count_source",
            "rep - CASE WHEN seq_no = 1 AND rep > 0 THEN 1 ELSE 0 END AS distinct_rule_hits_count_target",
            "n - rep AS missed_rule_hits_count_target",
            "mx + INTERVAL '4' DAY AS modified_timestamp", "rpt_grp_name",
            "n + rpt_grp_id % 3 AS rule_hit_publish_count_source",
        )
        return self._columns(out, "rule_hit_reconciliation")

    @cached_property
    def audit(self) -> DataFrame:
        """Exclusions are audited except for the AUTOMOBILE segment."""
        kept = self.hit_base.filter(F.col("exclusion_reason_id").isNotNull() & (F.col("activity_type") != "AUTOMOBILE"))
        out = kept.selectExpr(
            "attempt_id", "rpt_grp_id", "rule_id", "bucket_id", "rpt_grp_name", "external_txn_key",
            "concat('B', x_ym) AS processing_batch_id", "exclusion_reason_id",
            "CASE WHEN bucket_id % 2 = 0 THEN 'TRANSACTION_ONCE' ELSE 'TRANSACTION_PER_RULE' END AS exclusion_strategy",
            "reported_batch_id", "mtcn", "created_timestamp", "modified_timestamp", "reporting_timestamp",
        )
        return self._columns(out, "rule_hit_exclusion_audit")

    @cached_property
    def journey(self) -> DataFrame:
        """Latest state of each transaction; one region writes no journey at all."""
        k = (
            F.when(F.col("exclusion_reason_id") == "Txn is already reported", 4)
            .when(F.col("exclusion_reason_id").isNotNull(), 3)
            .when(F.col("x_tax") == 0, 2)
            .when(F.col("x_disc") <= 0.01, 1)
            .otherwise(0)
        )
        t = (
            self.hit_base.filter("x_region <> 'MIDDLE EAST'")
            .groupBy("rpt_grp_id", "x_ym", "external_txn_key", "mtcn")
            .agg(
                F.max("created_timestamp").alias("created_timestamp"),
                F.max("reporting_timestamp").alias("reporting_timestamp_latest"),
                F.max(k).alias("k"),
                F.every(F.col("is_reported").eqNullSafe(True)).alias("done"),
                F.max("x_qty").alias("q"),
            )
        )
        out = t.selectExpr(
            "rpt_grp_id", "concat('B', x_ym) AS batch_id", "CAST(external_txn_key AS STRING) AS identifier", "mtcn",
            "CASE WHEN k >= 3 THEN 'FILTRATION' WHEN k = 2 THEN 'TRANSACTION_JOIN' WHEN k = 0 AND done THEN 'REPORT_GENERATION' ELSE 'TRANSFORMATION' END AS stage",
            "CASE WHEN k >= 3 THEN 'EXCLUDED' WHEN k = 2 THEN 'ERROR' WHEN k = 1 THEN 'FAILURE' WHEN done THEN 'GENERATED' ELSE 'SUCCESS' END AS status",
            "CASE WHEN k = 4 THEN 'EXCLUDED_BECAUSE_ALREADY_REPORTED(TARGET)' WHEN k = 2 THEN 'ATTEMPT_NOT_RECEIVED' WHEN k = 1 THEN 'TRANSFORMATION_SKIPPED' END AS comments",
            "created_timestamp", "created_timestamp + INTERVAL '1' DAY AS modified_timestamp",
            "reporting_timestamp_latest", "k <> 2 AS processing_complete",
            "CASE WHEN q >= 50 THEN concat('{\"txn_sur_key\":\"', external_txn_key, '\"}') ELSE '{}' END AS txn_metadata",
            "CASE WHEN k = 2 THEN concat('Attempt ', external_txn_key, ' not yet recorded') END AS skip_reason",
        )
        return self._columns(out, "record_transformation_journey")

    @cached_property
    def batch_info(self) -> DataFrame:
        """Operational rows of the batches; batches without any duplicate drop have none."""
        out = self.batch_recon.filter("soft_dedup_dropped_txn_count > 0").selectExpr(
            "rpt_grp_id", "batch_id", "seq_no", "created_timestamp + INTERVAL '2' HOUR AS process_timestamp",
            "created_timestamp",
            "CASE WHEN txn_selected % 5 = 0 THEN 'Failed' WHEN txn_selected % 7 = 0 THEN 'In Progress' ELSE 'Generated' END AS batch_status",
            "CASE WHEN txn_selected % 5 = 0 THEN 'Data Transformation Failed' WHEN txn_selected % 11 = 0 THEN NULL ELSE 'Report Generation Completed' END AS compiler_status",
            "CASE WHEN txn_selected % 5 = 0 THEN 'FAILED' WHEN txn_selected % 3 = 0 THEN 'PARTIAL' ELSE 'ALL' END AS report_status",
            "CAST(CAST(rpt_look_back_date AS DATE) AS TIMESTAMP_NTZ) AS txn_lookback_start_timestamp",
            "CAST(CAST(rpt_from_date AS DATE) AS TIMESTAMP_NTZ) AS txn_start_timestamp",
            "CAST(CAST(rpt_to_date AS DATE) AS TIMESTAMP_NTZ) AS txn_end_timestamp",
        )
        return self._columns(out, "report_batch_info")

    @cached_property
    def group_config(self) -> DataFrame:
        n, r = self.base("nation"), self.base("region")
        out = n.join(r, n.n_regionkey == r.r_regionkey).selectExpr(
            "CAST(100 + n_nationkey AS INT) AS rpt_grp_id", "n_name AS rpt_grp_name", "r_name AS country_name",
            "n_nationkey <> 24 AS rpt_config_active_flag", "'R2' AS inbound_rule_id", "'R1' AS outbound_rule_id",
            "CASE n_regionkey WHEN 0 THEN 'TRANSACTION_ONCE' WHEN 1 THEN 'TRANSACTION_PER_RULE' WHEN 2 THEN 'INTRA_COUNTRY' WHEN 3 THEN 'SOMETHING_ELSE' END AS reconciliation_strategy_metadata",
        )
        return self._columns(out, "report_group_config")

    @cached_property
    def attempts(self) -> DataFrame:
        """Attempts that were received: every hit whose tax is above zero."""
        return self.hit_base.filter("x_tax > 0").selectExpr(
            "attempt_id", "CAST(external_txn_key AS STRING) AS txn_sur_key"
        )

    @cached_property
    def recon_log(self) -> DataFrame:
        out = self.hit_base.filter("NOT coalesce(is_reported, FALSE) AND source = 'TARGET'").selectExpr(
            "x_ym * 100 + 28 AS run_date", "1 AS seq_no", "rpt_grp_id",
            "CAST(external_txn_key AS STRING) AS external_txn_key", "rule_id", "attempt_id", "mtcn",
            "exclusion_reason_id", "is_reported",
            "CASE WHEN activity_type = 'BUILDING' THEN TRUE WHEN activity_type <> 'MACHINERY' THEN FALSE END AS is_processed",
            "bucket_id AS retry_count",
            "CASE WHEN activity_type = 'BUILDING' THEN 'DONE' WHEN activity_type = 'FURNITURE' THEN 'RETRY' END AS status",
            "source AS data_source",
            "CASE WHEN bucket_id >= 14 THEN created_timestamp + INTERVAL '30' DAY END AS future_reporting_date",
            "created_timestamp",
        )
        return self._columns(out, "rule_hit_reconciliation_log")

    @cached_property
    def recon_analysis(self) -> DataFrame:
        out = self.hit_base.filter("NOT is_reported AND x_tax > 0").selectExpr(
            "x_ym * 100 + 28 AS run_date", "1 AS seq_no", "rpt_grp_id",
            "CAST(external_txn_key AS STRING) AS txn_sur_key", "rule_id", "attempt_id", "created_timestamp",
            "CASE WHEN x_disc > 0.05 THEN 'Hit not published' WHEN x_disc > 0.02 THEN 'Late attempt' END AS description",
            "modified_timestamp", "mtcn", "rpt_grp_name",
        )
        return self._columns(out, "rule_hit_reconciliation_analysis")

    @cached_property
    def unprocessed(self) -> DataFrame:
        out = self.hit_base.filter("NOT coalesce(is_reported, FALSE) AND x_tax = 0").selectExpr(
            "rpt_grp_id", "rule_id", "attempt_id", "external_txn_key", "mtcn", "exclusion_reason_id", "is_reported",
            "bucket_id AS retry_count",
            "CASE WHEN bucket_id < 8 THEN 'NEW' WHEN bucket_id < 14 THEN 'RETRY' END AS status",
            "source AS data_source", "concat('C', attempt_id) AS correlation_id",
            "CAST(NULL AS TIMESTAMP_NTZ) AS future_reporting_date", "created_timestamp",
        )
        return self._columns(out, "unprocessed_rule_hits")

    @cached_property
    def cases_flat(self) -> DataFrame:
        out = self.order_parties.selectExpr(
            "CAST(o_orderkey AS STRING) AS mtcn", "c_name AS sender_name", "n_name AS sender_country",
            "CASE WHEN c_acctbal < 0 THEN 'Passport' ELSE 'National ID' END AS sender_id_type",
            "concat('Receiver ', c_mktsegment) AS receiver_name", "r_name AS receiver_country",
            "'Passport' AS receiver_id_type", "o_totalprice AS amount", "'USD' AS currency",
            "concat(n_name, ' > ', r_name) AS corridor", "o_orderpriority AS channel",
            "concat('list ', o_orderkey % 4) AS gsi_list", "concat('Receiver ', c_mktsegment) AS gsi_matched_name",
            "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS gsi_match_score",
            "'name, partial DOB,' AS gsi_matched_fields", "CAST(o_orderkey % 12 AS INT) AS transfers_30d",
            "o_totalprice * 2 AS total_30d_usd", "o_totalprice / 2 AS avg_amount_usd",
            "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Amounts just under the reporting threshold, new receiver' "
            "WHEN 1 THEN 'Consistent monthly pattern, Long-standing relationship' WHEN 2 THEN NULL ELSE 'Other' END AS flags",
        )
        return self._columns(out, "cases_flat")

    @cached_property
    def transfers(self) -> DataFrame:
        """Money transfers per sender: one per order."""
        return self.base("orders").selectExpr(
            "o_custkey AS sender_id", "o_orderkey AS txn_id", "CAST(o_orderdate AS DATE) AS sent_on",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        )

    @cached_property
    def case_events(self) -> DataFrame:
        return case_events(self.base("events"))

    @cached_property
    def submissions(self) -> DataFrame:
        return submissions(self.base("events"))

    @cached_property
    def claims(self) -> DataFrame:
        """Workers trying to take a queued case."""
        return self.case_events.filter("to_status = 'retrieving'").selectExpr(
            "case_id", "concat('w', CAST(value * 100 AS INT) % 5) AS worker", "event_id", "ts AS claimed_at"
        )

    @cached_property
    def stage_results(self) -> DataFrame:
        return stage_results(self.case_events)

    @cached_property
    def cases(self) -> DataFrame:
        """Lifecycle rows: the last event of a case sets its status."""
        last = self.case_events.groupBy("case_id", "owner_sub").agg(
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
            F.max_by("to_status", F.struct("ts", "event_id")).alias("status"),
            F.min(F.when(F.col("to_status") == "retrieving", F.col("ts"))).alias("claimed_at"),
        )
        return last.withColumns(
            {
                "failed_stage": F.when(F.col("status") == "error", "analyzing"),
                "error_reason": F.when(F.col("status") == "error", "STAGE_FAILED"),
            }
        )

    @cached_property
    def stream_entries(self) -> DataFrame:
        """Document texts cut into numbered chunks, closed by a done or error entry.

        Sources 0 and 1 never close; German texts end in an error.
        """
        d = self.base("documents").select("doc_id", "text", "lang", "source", F.length("text").alias("n"))
        chunks = F.transform(
            F.sequence(F.lit(0), F.ceil(F.col("n") / 200).cast("int") - 1),
            lambda i: F.struct(
                (i + 1).cast("bigint").alias("entry_id"),
                F.lit("chunk").alias("type"),
                F.substring(F.col("text"), i * 200 + 1, F.lit(200)).alias("data"),
            ),
        )
        last = F.array(
            F.struct(
                (F.ceil(F.col("n") / 200) + 1).cast("bigint").alias("entry_id"),
                F.when(F.col("lang") == "de", "error").otherwise("done").alias("type"),
                F.when(F.col("lang") == "de", "model timeout").alias("data"),
            )
        )
        closes = ~F.col("source").isin("src0", "src1")
        entries = d.filter("n > 0").select(
            F.concat(F.lit("s"), "doc_id").alias("session_id"),
            "doc_id",
            F.inline(F.when(closes, F.concat(chunks, last)).otherwise(chunks)),
        )
        return entries.selectExpr(
            "session_id", "entry_id", "type", "data",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id % 1440, entry_id) AS ts",
        )


def case_events(events: DataFrame) -> DataFrame:
    """Case transitions out of the raw event stream."""
    return events.selectExpr(
        "event_id", "ts", "concat('u', user_id) AS owner_sub", "concat(user_id, '-', event_id % 10) AS case_id",
        "CASE event_type WHEN 'signup' THEN 'retrieving' WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'doc_analysis' "
        "WHEN 'purchase' THEN 'complete' ELSE 'error' END AS to_status",
        "value", "props",
    )


def submissions(events: DataFrame) -> DataFrame:
    """Case submissions with the key a client repeats when it retries."""
    return events.filter("event_type = 'signup'").selectExpr(
        "concat(user_id, '-', event_id % 10) AS case_id", "concat('u', user_id) AS owner_sub",
        "concat(user_id, ':', get_json_object(props, '$.k')) AS idempotency_key", "event_id", "ts AS created_at",
    )


def stage_results(transitions: DataFrame) -> DataFrame:
    """What each stage of a case wrote, repeated writes included."""
    return transitions.filter("to_status IN ('retrieving', 'analyzing', 'doc_analysis')").selectExpr(
        "case_id", "to_status AS stage", "props AS output", "ts AS completed_at", "event_id"
    )


__all__ = ["SCHEMAS", "Tables", "case_events", "stage_results", "submissions"]
