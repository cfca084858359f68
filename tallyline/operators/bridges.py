"""Tests of which columns link the tables, and of how missed hits can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.aggregates import count_if, sure_total
from tallyline.functions.hits import required
from tallyline.functions.period import Period, narrow
from tallyline.operators.kpi import GROUP, HIT_TOTALS
from tallyline.operators.ranges import join_windows
from tallyline.operators.snapshots import latest, latest_recon
from tallyline.operators.validation import KEY, RUN, run_keys, top

# The columns tried as batch keys.
HIT_KEYS = ("batch_id", "efile_batch_id", "reported_batch_id")
AUDIT_KEYS = ("processing_batch_id", "reported_batch_id")


def _rows_per_candidate(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Row counts per (candidate, group, key): one scan for all candidates, summed before any join."""
    long = df.select("rpt_grp_id", *[F.col(c).cast("string").alias(f"{table}.{c}") for c in columns]).unpivot(
        ["rpt_grp_id"], [f"`{table}.{c}`" for c in columns], "candidate_bridge", "batch_id"
    )
    return long.filter("batch_id IS NOT NULL").groupBy("candidate_bridge", *KEY).agg(F.count("*").alias("n"))


def batch_bridge_candidates(batch_recon: DataFrame, hits: DataFrame, audit: DataFrame, p: Period) -> DataFrame:
    """For five candidate keys: rows and batch keys that match the batches of the period."""
    names = [f"rule_hit.{c}" for c in HIT_KEYS] + [f"exclusion_audit.{c}" for c in AUDIT_KEYS]
    counts = _rows_per_candidate(hits, "rule_hit", HIT_KEYS).unionByName(
        _rows_per_candidate(audit, "exclusion_audit", AUDIT_KEYS)
    )
    found = counts.join(run_keys(batch_recon, p), list(KEY))
    cand = F.col("candidate_bridge")
    wide = found.agg(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]),
            F.array(*[F.struct(sure_total(F.when(cand == n, F.col("n")), "r"), F.count_if(cand == n).alias("k")) for n in names]),
        ).alias("m")
    )
    return wide.select(F.explode("m").alias("candidate_bridge", "v")).select(
        "candidate_bridge", F.col("v.r").alias("matched_rows"), F.col("v.k").alias("matched_batch_keys")
    )


def journey_without_recon(journey: DataFrame, batch_recon: DataFrame, p: Period) -> dict[str, DataFrame]:
    j, r = run_keys(journey, p), run_keys(batch_recon, p)
    marked = j.join(r.withColumn("known", F.lit(True)), list(KEY), "left")
    return {
        "summary": marked.agg(
            F.count("*").alias("journey_batches"),
            count_if(F.col("known").isNotNull(), "with_reconciliation"),
            count_if(F.col("known").isNull(), "without_reconciliation"),
        ),
        "missing": j.join(r, list(KEY), "left_anti"),
    }


def bridge_by_group(
    batch_recon: DataFrame, hits: DataFrame, audit: DataFrame, p: Period, k: int | None = None
) -> dict[str, DataFrame]:
    """Evidence per batch, rolled up to groups. Distinct counts are per batch and then added.

    Distinct rules and customers per batch are counted over their own distinct
    (batch, value) rows, so no task ever holds a whole batch.
    """
    batches = (
        batch_recon.filter(p.holds("created_timestamp") & F.col("batch_id").isNotNull()).select(*GROUP, "batch_id").distinct()
    )
    keys = batches.select(*KEY).distinct()
    scoped = hits.withColumn("batch_id", F.col("efile_batch_id")).join(keys, list(KEY), "left_semi")
    # One shuffle of the hits, to (batch, rule, customer); the figures come from its counts.
    pairs = scoped.groupBy(*KEY, "rule_id", "mtcn").agg(F.count("*").alias("n"))
    rules = pairs.groupBy(*KEY, "rule_id").agg(F.sum("n").alias("n"))
    rules = rules.groupBy(*KEY).agg(F.sum("n").alias("rule_hit_rows"), F.count("rule_id").alias("distinct_rules"))
    mtcns = pairs.select(*KEY, "mtcn").distinct().groupBy(*KEY).agg(F.count("mtcn").alias("distinct_mtcns"))
    h = rules.join(mtcns, list(KEY))
    a = audit.groupBy("rpt_grp_id", F.col("processing_batch_id").alias("batch_id")).agg(F.count("*").alias("exclusion_rows"))
    names = ("rule_hit_rows", "distinct_rules", "distinct_mtcns", "exclusion_rows")
    c = (
        batches.join(h, list(KEY), "left").join(a, list(KEY), "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names})
    )
    with_hits, with_audit = F.col("rule_hit_rows") > 0, F.col("exclusion_rows") > 0
    return {
        "summary": c.agg(
            F.count("*").alias("transformation_batches"), count_if(with_hits, "batches_with_rule_hits"),
            count_if(with_audit, "batches_with_exclusions"), count_if(with_hits & with_audit, "batches_with_both"),
        ),
        "groups": c.groupBy(*GROUP).agg(
            F.count("*").alias("transformation_batches"), count_if(with_hits, "batches_with_rule_hits"),
            count_if(with_audit, "batches_with_exclusions"),
            *[F.sum(n).alias("total_" + n) for n in names],
        ).orderBy(F.desc("batches_with_rule_hits"), *GROUP),
        "samples": top(c.filter(with_hits | with_audit), k, F.desc("rule_hit_rows"), *KEY),
    }


def txn_bridge_candidates(batch_recon: DataFrame, journey: DataFrame, hits: DataFrame, p: Period) -> dict[str, DataFrame]:
    """Three ways to link a journey transaction to rule hits: matched, unique and ambiguous.

    Only whether a transaction reaches one or several external keys matters, so the hits
    shrink to the least and greatest external key per lookup key. The join then adds at
    most one row per journey row, even when one customer number covers a whole batch.
    All three ways share one pass over the journey and one over the hits.
    """
    runs = run_keys(batch_recon, p)
    j = (
        journey.join(runs, list(KEY), "left_semi")
        .select(*KEY, "identifier", "mtcn", F.get_json_object("txn_metadata", "$.txn_sur_key").alias("txn_sur_key"))
        .distinct()
    )
    ext = F.col("external_txn_key")

    def options(*triples: tuple[str, str, Column]) -> Column:
        return F.inline(
            F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(k).alias("kind"), v.alias("lookup")) for c, k, v in triples])
        )

    tries = (
        ("txn_metadata.txn_sur_key -> rule_hit.external_txn_key", "key", F.col("txn_sur_key")),
        ("journey.mtcn -> rule_hit.mtcn", "mtcn", F.col("mtcn")),
        ("journey.identifier -> rule_hit.external_txn_key", "key", F.col("identifier")),
    )
    wanted = j.select(*KEY, "identifier", options(*tries)).filter("lookup IS NOT NULL")
    side = (
        hits.withColumn("batch_id", F.col("efile_batch_id")).join(runs, list(KEY), "left_semi")
        .select(*KEY, ext, options(("", "key", ext.cast("string")), ("", "mtcn", F.col("mtcn")))).filter("lookup IS NOT NULL")
        .groupBy(*KEY, "kind", "lookup").agg(F.min(ext).alias("lo"), F.max(ext).alias("hi"))
    )
    per = (
        wanted.join(side, [*KEY, "kind", "lookup"])
        .groupBy("candidate", *KEY, "identifier").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    names = [t[0] for t in tries]
    counts = {"matched_transactions": F.lit(True), "uniquely_matched_transactions": F.col("lo") == F.col("hi"), "ambiguous_transactions": F.col("lo") < F.col("hi")}
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("candidate"), *[F.count_if((F.col("candidate") == n) & c).alias(m) for m, c in counts.items()])
            for n in names
        ]
    )
    summary = per.agg(rows.alias("r")).select(F.inline("r"))
    totals = j.agg(
        F.count("*").alias("total_journey_transactions"),
        F.count("txn_sur_key").alias("with_txn_sur_key"), F.count("mtcn").alias("with_mtcn"),
    )
    return {"summary": summary, "totals": totals}


def _definitions() -> dict[str, Column]:
    """Candidate definitions of a missed or matched hit."""
    f, ts, rb = F.col("is_reported"), F.col("reporting_timestamp"), F.col("reported_batch_id")
    false = F.lit(False)
    return {
        "missed_is_reported_false": required() & F.coalesce(~f, false),
        "missed_is_reported_not_true": required() & ~F.coalesce(f, false),
        "missed_reporting_timestamp_null": required() & ts.isNull(),
        "missed_reported_batch_null": required() & rb.isNull(),
        "matched_true_nonexcluded": required() & F.coalesce(f, false),
        "matched_true_all": F.coalesce(f, false),
        "matched_timestamp_present": ts.isNotNull(),
    }


# Definitions that an unmatched outer-join row (all nulls) satisfies.
TRUE_FOR_NOTHING = ("missed_is_reported_not_true", "missed_reporting_timestamp_null", "missed_reported_batch_null")


def missed_definition_candidates(
    hit_recon: DataFrame, hits: DataFrame, p: Period, anchor: str = "run_date", null_safe: bool = True
) -> dict[str, DataFrame]:
    """Counts of distinct (transaction, rule) keys in each run's selection window under seven
    definitions, and how often each equals the recorded figure.

    Distinct counts run in two steps: one row per (run, transaction, rule) with a flag per
    definition, then sums of flags per run. With ``null_safe`` a run whose window is empty
    counts zero; without it the all-null pair of an outer join counts as one key, as a
    distinct count over a row value does.
    """
    runs = latest_recon(hit_recon, p, anchor=anchor).select(
        *RUN, "rpt_grp_name", "created_timestamp", "data_selection_start_date", "data_selection_end_date",
        *[F.coalesce(F.col(c), F.lit(0)).alias(f"reconciliation_{n}") for c, n in HIT_TOTALS],
    )
    windows = runs.select(*RUN, "data_selection_start_date", "data_selection_end_date")
    defs = _definitions()
    facts = hits.select(
        "rpt_grp_id", "external_txn_key", "rule_id", "transaction_date", *[c.alias(n) for n, c in defs.items()]
    )
    inside = join_windows(
        facts, windows, ("rpt_grp_id",), "transaction_date", "data_selection_start_date", "data_selection_end_date"
    )
    per_key = inside.groupBy(*RUN, "external_txn_key", "rule_id").agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in defs]
    )
    per_run = per_key.groupBy(*RUN).agg(
        F.sum("n").alias("rule_hit_rows"), F.count("*").alias("distinct_rule_hit_keys"),
        *[F.count_if(F.col(c)).alias(c) for c in defs],
    )
    empty = {n: 0 for n in ("rule_hit_rows", "distinct_rule_hit_keys", *defs)}
    if not null_safe:
        empty.update({n: 1 for n in ("distinct_rule_hit_keys", *TRUE_FOR_NOTHING)})
    rows = runs.join(per_run, list(RUN), "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(v).cast("bigint")) for n, v in empty.items()}
    )
    rows = rows.withColumns(
        {f"variance_{n}": F.col(n) - F.col("reconciliation_missed" if n.startswith("missed") else "reconciliation_matched") for n in defs}
    )
    summary = rows.agg(
        F.count("*").alias("reconciliation_populations"),
        *[count_if(F.col(f"variance_{n}") == 0, f"{n}_exact_matches") for n in defs],
    )
    return {"summary": summary, "rows": rows}


WEEK = "INTERVAL 7 DAYS"


def locate_recon_detail(
    hit_recon: DataFrame, hits: DataFrame, rpt_grp_id: int | None = None, run_date: int | None = None, k: int | None = None
) -> dict[str, DataFrame]:
    """Where the hits behind a reconciliation row may be: counts by several time anchors.

    Works for one row or for all; ``k`` keeps the newest hits of each group as samples, or all. Hits are counted per (group, anchor, time) first, and one
    window join serves the four anchored counts.
    """
    runs = latest(narrow(hit_recon, rpt_grp_id=rpt_grp_id, run_date=run_date), ("rpt_grp_id", "run_date"))
    scoped = narrow(hits, rpt_grp_id=rpt_grp_id)
    lo, hi, made = F.col("data_selection_start_date"), F.col("data_selection_end_date"), F.col("created_timestamp")
    tests = {
        "by_transaction_date": ("transaction_date", lo, hi),
        "by_created_timestamp": ("created_timestamp", lo, hi),
        "by_reporting_timestamp": ("reporting_timestamp", lo, hi),
        "created_within_7_days": ("created_timestamp", made - F.expr(WEEK), made + F.expr(WEEK)),
    }
    windows = runs.select(
        *RUN,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("test"), F.lit(c).alias("anchor"), a.alias("w_start"), b.alias("w_end")) for n, (c, a, b) in tests.items()])
        ),
    )
    anchors = ["transaction_date", "created_timestamp", "reporting_timestamp"]
    counts = (
        scoped.unpivot(["rpt_grp_id"], anchors, "anchor", "at").filter("at IS NOT NULL")
        .groupBy("rpt_grp_id", "anchor", "at").agg(F.count("*").alias("n"))
    )
    found = (
        join_windows(counts, windows, ("rpt_grp_id", "anchor"), "at", "w_start", "w_end")
        .groupBy(*RUN).agg(*[F.sum(F.when(F.col("test") == n, F.col("n"))).alias(n) for n in tests])
    )
    all_rows = scoped.groupBy("rpt_grp_id").agg(F.count("*").alias("all_rule_hit_rows"))
    none = F.lit(0).cast("bigint")
    rows = (
        runs.select(
            *RUN, "rpt_grp_name", "created_timestamp", "modified_timestamp", "data_selection_start_date",
            "data_selection_end_date", *[F.col(c).alias(n) for c, n in HIT_TOTALS],
        )
        .join(all_rows, "rpt_grp_id", "left").join(found, list(RUN), "left")
        .withColumns({n: F.coalesce(F.col(n), none) for n in ("all_rule_hit_rows", *tests)})
    )
    samples = scoped.join(runs.select("rpt_grp_id").distinct(), "rpt_grp_id", "left_semi")
    if k is not None:
        # row_number <= k is limited per task before the shuffle, so a large group stays cheap.
        newest = Window.partitionBy("rpt_grp_id").orderBy(F.desc_nulls_last("created_timestamp"), "attempt_id", "rule_id", "bucket_id")
        samples = samples.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k).drop("place")
    samples = samples.select(
        "rpt_grp_id", "rule_id", "attempt_id", "bucket_id", "external_txn_key", "mtcn", "is_reported", "exclusion_reason_id",
        "transaction_date", "created_timestamp", "reporting_timestamp", "efile_batch_id", "reported_batch_id",
    )
    return {"summary": rows, "samples": samples}
