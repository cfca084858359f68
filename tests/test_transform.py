from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import transform as T
from tests.conftest import at, one, rows_of


def hit(n, **kw):
    row = dict(
        rpt_grp_id=1, bucket_id=0, rule_id="R1", attempt_id=n, external_txn_key=n, mtcn=f"M{n}", galactic_id=f"G{n}",
        transaction_date=at(2026, 6, 10), created_timestamp=at(2026, 6, 11), modified_timestamp=at(2026, 6, 11),
    )
    return row | kw


def config(make, **strategies):
    return make(
        "report_group_config",
        [
            dict(rpt_grp_id=int(g[1:]), inbound_rule_id="R2", outbound_rule_id="R1", reconciliation_strategy_metadata=s)
            for g, s in strategies.items()
        ],
    )


def test_selection_skips_batched_and_excluded_hits(make):
    t = make("rule_hit", [hit(1), hit(2, efile_batch_id="B"), hit(3, exclusion_reason_id="x"), hit(4, transaction_date=at(2026, 7, 1)), hit(5, rule_id="R9")])
    got = T.select_rule_hits(t, at(2026, 6, 1), at(2026, 6, 30), [1], ["R1"])
    assert rows_of(got, "attempt_id") == [(1,)]


def test_sml_rows_leave_and_null_keys_stay(make):
    t = make("rule_hit", [hit(1, mtcn="SML1"), hit(2, galactic_id="xSMLx"), hit(3, mtcn=None, galactic_id=None), hit(4, mtcn=None)])
    assert rows_of(T.drop_sml(t), "attempt_id") == [(3,), (4,)]


def test_keys_follow_the_strategy(make):
    cfg = config(make, g1="TRANSACTION_ONCE", g2="TRANSACTION_PER_RULE", g3="INTRA_COUNTRY", g4="UNHEARD_OF")
    rows = [hit(10 * g + i, rpt_grp_id=g, external_txn_key=7, rule_id=r) for g in (1, 2, 3, 4, 5) for i, r in enumerate(("R1", "R2", "R3", "R3"))]
    got = T.recon_keys(make("rule_hit", rows), cfg)
    per = {g: sorted(str(r.key_part) for r in got.filter(F.col("rpt_grp_id") == g).collect()) for g in (1, 2, 3, 4, 5)}
    assert per == {1: ["None"], 2: ["R1", "R2", "R3"], 3: ["IN", "None", "OUT"], 4: ["None"], 5: ["None"]}


def test_a_key_is_excluded_only_when_all_its_rows_are(make):
    t = make("rule_hit", [hit(1, external_txn_key=7, exclusion_reason_id="x"), hit(2, external_txn_key=7), hit(3, external_txn_key=8, exclusion_reason_id="y")])
    got = {r.key_txn: r.is_excluded for r in T.key_excluded(t, config(make)).collect()}
    assert got == {"7": False, "8": True}


def test_a_key_is_missing_only_when_no_attempt_arrived(make):
    t = make("rule_hit", [hit(1, external_txn_key=7), hit(2, external_txn_key=7), hit(3, external_txn_key=8), hit(4, external_txn_key=8)])
    arrived = make("attempts_by_surrogate_key", [dict(attempt_id=1, txn_sur_key="7"), dict(attempt_id=1, txn_sur_key="7")])
    out = T.missing_attempts(t, arrived, config(make))
    assert rows_of(out["kept"], "attempt_id") == [(1,), (2,)]
    assert one(out["counts"])["missing_attempt_keys"] == 1
    assert one(out["evidence"])["comments"] == "ATTEMPT_NOT_RECEIVED"
    off = T.missing_attempts(t, arrived, config(make), "disabled")
    assert (off["kept"].count(), off["counts"].count(), off["evidence"].count()) == (4, 0, 0)
    # By rule, the second row of key 7 is a key of its own and is missing.
    per_rule = make("rule_hit", [hit(1, external_txn_key=7), hit(2, external_txn_key=7, rule_id="R2")])
    out = T.missing_attempts(per_rule, arrived, config(make, g1="TRANSACTION_PER_RULE"), "csv")
    assert rows_of(out["kept"], "attempt_id") == [(1,)] and rows_of(out["evidence"], "key_part") == [("R2",)]


def test_already_reported_looks_at_other_hits_of_the_key(make):
    t = make("rule_hit", [hit(1, external_txn_key=7), hit(2, external_txn_key=7, efile_batch_id="B", is_reported=True), hit(3)])
    out = T.already_reported(T.select_rule_hits(t), t, config(make), "LEDGER")
    assert rows_of(out["kept"], "attempt_id") == [(3,)]
    assert one(out["evidence"])["comments"] == "EXCLUDED_BECAUSE_ALREADY_REPORTED(LEDGER)"


def test_a_hit_is_not_excluded_by_its_own_report(make):
    """A key's only reported hit stays; with two, neither does; a lone hit stays."""
    rows = [hit(1, external_txn_key=7, is_reported=True), hit(2, external_txn_key=7)]
    rows += [hit(i, external_txn_key=8, is_reported=True) for i in (3, 4)] + [hit(5, external_txn_key=9, is_reported=True)]
    t = make("rule_hit", rows)
    out = T.already_reported(T.select_rule_hits(t), t, config(make))
    assert rows_of(out["kept"], "attempt_id") == [(1,), (5,)]


def test_soft_dedup_keeps_the_latest_attempt_and_counts_the_rest(make):
    t = make("rule_hit", [hit(5, external_txn_key=7), hit(9, external_txn_key=7), hit(3)])
    assert rows_of(T.soft_dedup(t, config(make)), "attempt_id") == [(3,), (9,)]
    got = one(T.soft_dedup_dropped(t, config(make)))
    assert (got["rows_in"], got["rows_kept"], got["soft_dedup_dropped_txn_count"]) == (3, 2, 1)


def test_future_reporting_windows(make, spark):
    info = make(
        "report_batch_info",
        [dict(rpt_grp_id=1, batch_id="B", seq_no=1, txn_lookback_start_timestamp=at(2026, 6, 1), txn_start_timestamp=at(2026, 6, 8), txn_end_timestamp=at(2026, 6, 14))],
    )
    late = dict(created_timestamp=at(2026, 6, 20))
    t = make(
        "rule_hit",
        [
            hit(1, reporting_timestamp=at(2026, 6, 1), **late),
            hit(2, reporting_timestamp=at(2026, 6, 8), **late),
            hit(3, reporting_timestamp=at(2026, 6, 14), **late),
            hit(4, reporting_timestamp=at(2026, 6, 14, 0, 0, 1), **late),
            # Created on the day of the report: not a future report.
            hit(5, reporting_timestamp=at(2026, 6, 9, 1), created_timestamp=at(2026, 6, 9, 23)),
        ],
    )
    w = T.batch_windows(info)
    assert one(T.future_reporting(t, w, "lookback"))["future_reporting_txn"] == 1
    assert one(T.future_reporting(t, w, "period"))["future_reporting_txn"] == 2


def test_a_batch_row_from_raw_hits(make):
    info = make(
        "report_batch_info",
        [dict(rpt_grp_id=1, batch_id="B", seq_no=1, txn_lookback_start_timestamp=at(2026, 6, 1), txn_start_timestamp=at(2026, 6, 8), txn_end_timestamp=at(2026, 6, 14))],
    )
    rows = [
        hit(1, external_txn_key=1, transaction_date=at(2026, 6, 2)),  # lookback
        hit(2, external_txn_key=2), hit(3, external_txn_key=2),  # one key, one row dropped
        hit(4, external_txn_key=3, exclusion_reason_id="x"),  # excluded key
        hit(5, external_txn_key=4),  # no attempt
        hit(6, external_txn_key=5), hit(7, external_txn_key=5, efile_batch_id="A", is_reported=True),  # reported before
        hit(8, external_txn_key=6, mtcn="SML8"),  # marked
        hit(9, external_txn_key=7, transaction_date=at(2026, 6, 15)),  # outside
        hit(10, external_txn_key=8, reporting_timestamp=at(2026, 6, 10)),  # reported in the period before its creation day
    ]
    arrived = make("attempts_by_surrogate_key", [dict(attempt_id=i, txn_sur_key="t") for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)])
    got = one(T.build_batch_reconciliation(make("rule_hit", rows), arrived, config(make), T.batch_windows(info)))
    assert got == dict(
        rpt_grp_id=1, batch_id="B", txn_selected=7, excluded_txn=1, txn_missing_attempt_count=1, already_reported_count=1,
        expected_reportable_txn=3, lookback_txn=1, lookback_future_reporting_txn=0, lookback_actual_txn=1,
        reporting_period_txn=2, reporting_period_future_reporting_txn=1, reporting_period_actual_txn=1, activity_selected=3,
        soft_dedup_dropped_txn_count=1,
    )


def test_assign_batch_marks_only_the_chosen(make):
    t = make("rule_hit", [hit(1), hit(2, efile_batch_id="A", is_reported=True)])
    got = {r.attempt_id: (r.efile_batch_id, r.is_reported) for r in T.assign_batch(t, T.select_rule_hits(t), F.lit("B"), at(2026, 7, 1)).collect()}
    assert got == {1: ("B", False), 2: ("A", True)}


def test_expected_keys_need_not_exist_on_the_other_side(frame):
    e = frame("rpt_grp_id INT, k INT", [(1, 1), (1, 2), (1, 2), (2, 9)])
    a = frame("rpt_grp_id INT, k INT", [(1, 1), (2, 1)])
    assert rows_of(T.expected_matched_missed(e, a, ("k",))) == [(1, 2, 1, 1), (2, 1, 0, 1)]
