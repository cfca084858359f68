"""The batch transformer's selection and reconciliation rules over raw rule hits.

A reconciliation key is what a report group counts as one thing. It is written as three
columns (rpt_grp_id, key_txn, key_part): key_part is null, the rule or the side,
depending on the group's strategy, so groups of all strategies go through one plan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.aggregates import sure_total
from tallyline.functions.hits import excluded, required
from tallyline.functions.markers import failed, generated, transformed
from tallyline.operators.ranges import join_windows
from tallyline.operators.snapshots import latest, upsert_latest
from tallyline.sources.tables import schema

# Reconciliation strategies; anything else means the first.
ONCE, PER_RULE, INTRA_COUNTRY = "TRANSACTION_ONCE", "TRANSACTION_PER_RULE", "INTRA_COUNTRY"
KEY = ("rpt_grp_id", "key_txn", "key_part")
HIT_PK = ("rpt_grp_id", "bucket_id", "rule_id", "attempt_id")
JOURNEY_PK = ("rpt_grp_id", "batch_id", "identifier")
BATCH_INFO_PK = ("rpt_grp_id", "batch_id", "seq_no")
REMOVED_MARK = "SML"


def select_rule_hits(
    hits: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    groups: list[int] | None = None,
    rules: list[str] | None = None,
) -> DataFrame:
    """Hits a new batch may take: in its window, not in a batch yet and not excluded."""
    out = hits.filter(F.col("efile_batch_id").isNull() & required())
    if start is not None:
        out = out.filter(F.col("transaction_date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("transaction_date") <= F.lit(end))
    if groups is not None:
        out = out.filter(F.col("rpt_grp_id").isin(groups))
    if rules is not None:
        out = out.filter(F.col("rule_id").isin(rules))
    return out


def is_sml() -> Column:
    """Either customer key carries the mark; a null key does not."""
    return F.coalesce(F.col("galactic_id").contains(REMOVED_MARK), F.lit(False)) | F.coalesce(
        F.col("mtcn").contains(REMOVED_MARK), F.lit(False)
    )


def drop_sml(hits: DataFrame) -> DataFrame:
    return hits.filter(~is_sml())


def with_recon_key(hits: DataFrame, config: DataFrame, txn: str = "external_txn_key") -> DataFrame:
    """Add the reconciliation key according to the group's strategy.

    Groups without configuration count each transaction once. For the activity side pass
    ``txn='txn_sur_key'``.
    """
    side = F.when(F.col("rule_id") == F.col("inbound_rule_id"), "IN").when(
        F.col("rule_id") == F.col("outbound_rule_id"), "OUT"
    )
    strategy = F.col("reconciliation_strategy_metadata")
    part = F.when(strategy == PER_RULE, F.col("rule_id")).when(strategy == INTRA_COUNTRY, side)
    rules = config.select("rpt_grp_id", "inbound_rule_id", "outbound_rule_id", "reconciliation_strategy_metadata")
    return (
        hits.join(rules, "rpt_grp_id", "left")
        .withColumns({"key_txn": F.col(txn).cast("string"), "key_part": part})
        .drop("inbound_rule_id", "outbound_rule_id", "reconciliation_strategy_metadata")
    )


def recon_keys(hits: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct reconciliation keys with the rows behind each."""
    return with_recon_key(hits, config).groupBy(*KEY).agg(F.count("*").alias("row_count"))


def key_excluded(hits: DataFrame, config: DataFrame) -> DataFrame:
    """A key is excluded only when all its rows have an exclusion reason."""
    return with_recon_key(hits, config).groupBy(*KEY).agg(
        F.count("*").alias("row_count"), F.count_if(excluded()).alias("excluded_rows"),
        F.every(excluded()).alias("is_excluded"),
    )


def with_attempts(hits: DataFrame, attempts: DataFrame) -> DataFrame:
    """Look up the transaction each attempt led to (null when it has not arrived)."""
    one = attempts.groupBy("attempt_id").agg(F.min("txn_sur_key").alias("txn_sur_key"))
    return hits.join(one, "attempt_id", "left")


def missing_keys(hits: DataFrame, attempts: DataFrame, config: DataFrame) -> DataFrame:
    """Keys none of whose attempts arrived."""
    return (
        with_recon_key(with_attempts(hits, attempts), config)
        .groupBy(*KEY)
        .agg(F.count("*").alias("row_count"), F.every(F.col("txn_sur_key").isNull()).alias("is_missing"))
        .filter("is_missing")
        .drop("is_missing")
    )


def same_key(a: str, b: str) -> Column:
    """Equality of two reconciliation keys; a null part equals a null part."""
    return (
        (F.col(f"{a}.rpt_grp_id") == F.col(f"{b}.rpt_grp_id"))
        & (F.col(f"{a}.key_txn") == F.col(f"{b}.key_txn"))
        & F.col(f"{a}.key_part").eqNullSafe(F.col(f"{b}.key_part"))
    )


def missing_attempts(hits: DataFrame, attempts: DataFrame, config: DataFrame, mode: str = "journey") -> dict[str, DataFrame]:
    """Treat keys without any arrived attempt.

    ``disabled`` keeps everything and counts nothing; ``csv`` and ``journey`` remove and
    count the keys. ``evidence`` is what to log: rows for a file, or journey entries.
    """
    if mode not in ("disabled", "csv", "journey"):
        raise ValueError(f"unknown mode {mode}")
    gone = missing_keys(hits, attempts, config)
    if mode == "disabled":
        return {"kept": hits, "counts": gone.limit(0).groupBy("rpt_grp_id").count(), "evidence": gone.limit(0)}
    keyed = with_recon_key(hits, config)
    kept = keyed.alias("h").join(gone.alias("g"), same_key("h", "g"), "left_anti").drop("key_txn", "key_part")
    evidence = gone
    if mode == "journey":
        evidence = gone.select(
            "rpt_grp_id", F.col("key_txn").alias("identifier"), F.lit("TRANSACTION_JOIN").alias("stage"),
            F.lit("ERROR").alias("status"), F.lit("ATTEMPT_NOT_RECEIVED").alias("comments"),
        ).distinct()
    counts = gone.groupBy("rpt_grp_id").agg(F.count("*").alias("missing_attempt_keys"))
    return {"kept": kept, "counts": counts, "evidence": evidence}


def reported_keys(hits: DataFrame, config: DataFrame) -> DataFrame:
    """Keys with reported hits and how many."""
    return with_recon_key(hits.filter("is_reported"), config).groupBy(*KEY).agg(F.count("*").alias("reported_hits"))


def already_reported(
    candidates: DataFrame, hits: DataFrame, config: DataFrame, system: str = "TARGET"
) -> dict[str, DataFrame]:
    """Split candidates by whether another hit of their key was reported before.

    The rule itself is not published; this is our reading. It cannot rest on the row's own
    exclusion reason, since candidates have none. Candidates are rows of ``hits``, so a
    reported candidate is one of its key's reported hits, and not another one.
    """
    keyed = with_recon_key(candidates, config).alias("h")
    known = reported_keys(hits, config).alias("r")
    flagged = keyed.join(known, same_key("h", "r"), "left").select("h.*", "reported_hits")
    others = F.coalesce("reported_hits", F.lit(0)) - F.coalesce("is_reported", F.lit(False)).cast("int")
    kept = flagged.filter(others == 0).drop("reported_hits")
    seen = flagged.filter(others > 0)
    evidence = seen.select(
        "rpt_grp_id", F.col("key_txn").alias("identifier"), F.lit("FILTRATION").alias("stage"),
        F.lit("EXCLUDED").alias("status"),
        F.lit(f"EXCLUDED_BECAUSE_ALREADY_REPORTED({system})").alias("comments"),
    ).distinct()
    return {"kept": kept.drop("key_txn", "key_part"), "evidence": evidence}


def soft_dedup(hits: DataFrame, config: DataFrame) -> DataFrame:
    """One row per reconciliation key: the one of the latest attempt (our reading of the rule).

    Ties on the attempt fall to the greater rule and bucket.
    """
    keyed = with_recon_key(hits, config)
    return latest(keyed, KEY, ("attempt_id", "rule_id", "bucket_id")).drop("key_txn", "key_part")


def soft_dedup_dropped(hits: DataFrame, config: DataFrame) -> DataFrame:
    """Rows the soft dedup drops per group: rows less distinct keys, without sorting anything."""
    per_key = recon_keys(hits, config)
    return per_key.groupBy("rpt_grp_id").agg(
        F.sum("row_count").alias("rows_in"), F.count("*").alias("rows_kept"),
        (F.sum("row_count") - F.count("*")).alias("soft_dedup_dropped_txn_count"),
    )


def _created_later() -> Column:
    return F.to_date("created_timestamp") > F.to_date("reporting_timestamp")


def in_future_lookback(later: Column | None = None) -> Column:
    ts = F.col("reporting_timestamp")
    return (ts >= F.col("lookback_start_ts")) & (ts < F.col("from_ts")) & (_created_later() if later is None else later)


def in_future_period(later: Column | None = None) -> Column:
    ts = F.col("reporting_timestamp")
    return (ts >= F.col("from_ts")) & (ts <= F.col("to_ts")) & (_created_later() if later is None else later)


def batch_windows(batch_info: DataFrame) -> DataFrame:
    """Selection windows of the batches' latest runs."""
    newest = latest(batch_info, ("rpt_grp_id", "batch_id"), ("seq_no", "created_timestamp"))
    return newest.select(
        "rpt_grp_id", "batch_id", F.col("txn_lookback_start_timestamp").alias("lookback_start_ts"),
        F.col("txn_start_timestamp").alias("from_ts"), F.col("txn_end_timestamp").alias("to_ts"),
    )


def future_reporting(hits: DataFrame, windows: DataFrame, which: str) -> DataFrame:
    """Hits per batch whose report lies in the lookback or the period but before their creation day."""
    start, end, test = {
        "lookback": ("lookback_start_ts", "from_ts", in_future_lookback()),
        "period": ("from_ts", "to_ts", in_future_period()),
    }[which]
    dated = hits.filter(F.col("reporting_timestamp").isNotNull()).select(
        "rpt_grp_id", "created_timestamp", "reporting_timestamp"
    )
    inside = join_windows(dated, windows, ("rpt_grp_id",), "reporting_timestamp", start, end).filter(test)
    return inside.groupBy("rpt_grp_id", "batch_id").agg(F.count("*").alias("future_reporting_txn"))


def batch_keys(hits: DataFrame, attempts: DataFrame, config: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per batch and reconciliation key of its window, with what became of the key.

    Steps: hits in the batch window that are in no batch yet; keys fully excluded; rows
    with an exclusion or the SML mark leave; keys without arrived attempts and keys
    reported before leave; the latest attempt of each remaining key is kept. Selected,
    excluded, missing, already reported and reportable figures count keys; the dedup
    figure counts rows. A key counts as already reported if every live row of it has
    another reported hit; a live row that is the key's only reported hit stays alone. Everything after the joins is
    partial aggregations, per (batch, key) here and per batch in ``build_batch_reconciliation``. What a row's texts, times
    and attempt say becomes yes or no before it travels.
    """
    live = required() & ~is_sml()
    pool = hits.filter(F.col("efile_batch_id").isNull()).select(
        *HIT_PK, "external_txn_key", excluded().alias("excluded"), live.alias("live"),
        (live & F.coalesce("is_reported", F.lit(False))).alias("own"), "transaction_date", "reporting_timestamp", _created_later().alias("later"),
    )
    inside = join_windows(pool, windows, ("rpt_grp_id",), "transaction_date", "lookback_start_ts", "to_ts")
    inside = inside.select(
        *HIT_PK, "external_txn_key", "batch_id", "excluded", "live", "own",
        (F.col("transaction_date") < F.col("from_ts")).alias("look"), (F.col("transaction_date") >= F.col("from_ts")).alias("per"),
        F.coalesce(in_future_lookback(F.col("later")), F.lit(False)).alias("future_look"),
        F.coalesce(in_future_period(F.col("later")), F.lit(False)).alias("future_per"),
    )
    arrived = attempts.filter(F.col("txn_sur_key").isNotNull()).select("attempt_id").distinct().withColumn("arrived", F.lit(True))
    inside = inside.join(arrived, "attempt_id", "left").withColumn("arrived", F.coalesce("arrived", F.lit(False)))
    keyed = with_recon_key(inside, config)
    live, own = F.col("live"), F.col("own")
    kept = F.struct("attempt_id", "rule_id", "bucket_id")
    row = F.struct("look", "per", "future_look", "future_per", "arrived")
    per_key = keyed.groupBy("batch_id", *KEY).agg(
        F.every("excluded").alias("all_excluded"),
        F.count_if(live).alias("live_rows"),
        F.every(F.when(live, ~F.col("arrived"))).alias("all_missing"),
        F.count_if(own).alias("own_reported"),
        F.max_by(F.when(live, row), F.when(live, kept)).alias("r_any"),
        F.max_by(F.when(own, row), F.when(own, kept)).alias("r_own"),
    )
    known = reported_keys(hits, config)
    flagged = per_key.alias("h").join(known.alias("r_"), same_key("h", "r_"), "left").select("h.*", "reported_hits")
    times = F.coalesce("reported_hits", F.lit(0))
    alone = (times == 1) & (F.col("own_reported") == 1)
    flagged = flagged.withColumns(
        {
            "was_reported": (times > 0) & ~alone, "r": F.when(alone, F.col("r_own")).otherwise(F.col("r_any")),
            "left_rows": F.when(alone, F.lit(1)).otherwise(F.col("live_rows")),
        }
    ).drop("r_any", "r_own")
    has_rows = F.col("live_rows") > 0
    missing = has_rows & F.col("all_missing")
    already = has_rows & ~F.col("all_missing") & F.col("was_reported")
    left = has_rows & ~F.col("all_missing") & ~F.col("was_reported")
    return flagged.withColumns({"missing": missing, "already": already, "kept": left}).select("*", "r.*")


def _key_counts() -> list[Column]:
    """The figures of a batch row that count keys of ``batch_keys``, and the rows its dedup drops."""
    look, per = F.col("kept") & F.col("look"), F.col("kept") & F.col("per")
    future_look, future_per = look & F.col("future_look"), per & F.col("future_per")

    def n(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    return [
        F.count("*").alias("txn_selected"),
        n(F.col("all_excluded"), "excluded_txn"),
        n(F.col("missing"), "txn_missing_attempt_count"),
        n(F.col("already"), "already_reported_count"),
        n(F.col("kept"), "expected_reportable_txn"),
        n(look, "lookback_txn"), n(future_look, "lookback_future_reporting_txn"),
        n(look & ~future_look, "lookback_actual_txn"),
        n(per, "reporting_period_txn"), n(future_per, "reporting_period_future_reporting_txn"),
        n(per & ~future_per, "reporting_period_actual_txn"),
        n(look | per, "activity_selected"),
        sure_total(F.when(F.col("kept"), F.col("left_rows") - 1), "soft_dedup_dropped_txn_count"),
    ]


def build_batch_reconciliation(
    hits: DataFrame, attempts: DataFrame, config: DataFrame, windows: DataFrame
) -> DataFrame:
    """The figures of one reconciliation row per batch that raw hits alone decide (see ``batch_keys``)."""
    return batch_keys(hits, attempts, config, windows).groupBy("rpt_grp_id", "batch_id").agg(*_key_counts())


def batch_reconciliation_rows(
    hits: DataFrame, attempts: DataFrame, config: DataFrame, windows: DataFrame, journey: DataFrame, stored: DataFrame, at: datetime
) -> DataFrame:
    """Whole rows of the batch reconciliation table, all 31 columns, to be appended to the stored snapshots.

    ``seq_no`` follows the batch's greatest stored one and starts at 1. Dates are those of the batch window, both
    timestamps are ``at``. The published notes name the other figures without defining them; our reading:

    - actual_reportable_txn: what this batch reports itself, the actual part of lookback and period. The reportable
      control therefore shows what was reported before its creation day.
    - activity_missing: kept keys whose latest attempt has not arrived (another one of the key has); those left are
      expected to be eligible.
    - actual eligible: of these, keys whose transaction reached transformation in the batch's journey; transformed if
      it succeeded or was reported, failed if it only failed. The transformation control holds by construction.
    - duplicate_transformation: transformed keys beyond the first of their transaction.
    - simulated figures are 0, since raw hits carry no mark of a simulation.

    Keys are summed to transactions before they meet the journey, which comes as one row per transaction, so that join
    never multiplies and the sum per batch follows it. A journey without rows gives no eligible keys, a batch without
    configuration has no name.
    """
    ready = F.col("kept") & F.col("arrived")
    txns = batch_keys(hits, attempts, config, windows).groupBy("rpt_grp_id", "batch_id", "key_txn").agg(
        *_key_counts(), F.count_if(F.col("kept") & ~ready).alias("activity_missing"), F.count_if(ready).alias("ready")
    )
    states = journey.groupBy("rpt_grp_id", "batch_id", F.col("identifier").alias("key_txn")).agg(
        F.bool_or(transformed() | generated()).alias("done"), F.bool_or(failed()).alias("failed")
    )
    done = F.coalesce("done", F.lit(False))
    only_failed = F.coalesce("failed", F.lit(False)) & ~done
    counted = [c for c in txns.columns if c not in ("rpt_grp_id", "batch_id", "key_txn")]
    sums = txns.join(states, ["rpt_grp_id", "batch_id", "key_txn"], "left").groupBy("rpt_grp_id", "batch_id").agg(
        *[F.sum(c).alias(c) for c in counted],
        sure_total(F.when(done, F.col("ready")), "activity_transformed"),
        sure_total(F.when(only_failed, F.col("ready")), "activity_transformation_failed"),
        sure_total(F.when(done & (F.col("ready") > 1), F.col("ready") - 1), "duplicate_transformation"),
    )
    last = stored.groupBy("rpt_grp_id", "batch_id").agg(F.max("seq_no").alias("last_seq"))
    names = config.groupBy("rpt_grp_id").agg(F.max("rpt_grp_name").alias("rpt_grp_name"))
    whole = sums.join(windows, ["rpt_grp_id", "batch_id"]).join(last, ["rpt_grp_id", "batch_id"], "left").join(names, "rpt_grp_id", "left")
    layout = schema("report_transformation_reconciliation")
    stamp = F.lit(at).cast(layout["created_timestamp"].dataType)
    day = {"rpt_look_back_date": "lookback_start_ts", "rpt_from_date": "from_ts", "rpt_to_date": "to_ts"}
    return whole.withColumns(
        {
            "seq_no": F.coalesce("last_seq", F.lit(0)) + 1,
            **{name: F.date_format(ts, "yyyy-MM-dd") for name, ts in day.items()},
            "actual_reportable_txn": F.col("lookback_actual_txn") + F.col("reporting_period_actual_txn"),
            "expected_activity_eligible_for_transformation": F.col("ready"),
            "actual_activity_eligible_for_transformation": F.col("activity_transformed") + F.col("activity_transformation_failed"),
            **{name: F.lit(0).cast("long") for name in ("txn_simulated", "activity_simulated")},
            **{name: stamp for name in ("created_timestamp", "modified_timestamp")},
        }
    ).select(*layout.fieldNames())


def assign_batch(hits: DataFrame, chosen: DataFrame, batch_id: Column, at: datetime) -> DataFrame:
    """Rule-hit table after the chosen hits went into a batch: efile batch set, not reported yet."""
    changes = chosen.select(*HIT_PK, batch_id.alias("_new")).dropDuplicates(HIT_PK).withColumn("_chosen", F.lit(True))
    stamp = F.lit(at).cast(hits.schema["modified_timestamp"].dataType)
    new = {"efile_batch_id": F.col("_new"), "is_reported": F.lit(False), "modified_timestamp": stamp}
    marked = hits.join(changes, list(HIT_PK), "left")
    return marked.withColumns({c: F.when(F.col("_chosen"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_new", "_chosen")


def expected_matched_missed(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...], group: str = "rpt_grp_id") -> DataFrame:
    """Per group: expected keys, those found and those not found. Counts only, since a
    missed key need not exist on the actual side."""
    e = expected.select(group, *keys).distinct()
    a = actual.select(group, *keys).distinct().withColumn("found", F.lit(True))
    return e.join(a, [group, *keys], "left").groupBy(group).agg(
        F.count("*").alias("expected"), F.count("found").alias("matched"), (F.count("*") - F.count("found")).alias("missed")
    )
