from __future__ import annotations

import random

import pytest

from tallyline.functions import controls as C
from tallyline.operators import batches, kpi, validation
from tests.conftest import at, one, rows_of


def balanced_rows(n: int, seed: int) -> list[dict]:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lb_a, lb_f, rp_a, rp_f, sim = (rnd.randint(0, 50) for _ in range(5))
        ok, bad = rnd.randint(0, 50), rnd.randint(0, 5)
        out.append(
            dict(
                batch_id=f"b{i}", rpt_grp_id=i % 3, rpt_grp_name=f"g{i % 3}", seq_no=1, created_timestamp=at(2026, 6, 2),
                lookback_actual_txn=lb_a, lookback_future_reporting_txn=lb_f, lookback_txn=lb_a + lb_f,
                reporting_period_actual_txn=rp_a, reporting_period_future_reporting_txn=rp_f, reporting_period_txn=rp_a + rp_f,
                activity_simulated=sim, activity_selected=lb_a + lb_f + rp_a + rp_f + sim,
                activity_transformed=ok, activity_transformation_failed=bad,
                actual_activity_eligible_for_transformation=ok + bad, expected_activity_eligible_for_transformation=ok + bad,
                expected_reportable_txn=ok, actual_reportable_txn=ok,
            )
        )
    return out


FIELD = {
    "reportable": "expected_reportable_txn", "eligibility": "expected_activity_eligible_for_transformation",
    "lookback": "lookback_txn", "reporting_period": "reporting_period_txn", "activity": "activity_selected",
    "transformation": "actual_activity_eligible_for_transformation",
}


@pytest.mark.parametrize("seed", [1, 2])
def test_balanced_rows_balance_and_faults_show_their_size(make, june, seed):
    rows = balanced_rows(30, seed)
    table = make("report_transformation_reconciliation", rows)
    for name in FIELD:
        assert {r.difference for r in batches.control(table, june, name).collect()} == {0}
    for name, column in FIELD.items():
        broken = [dict(r) for r in rows]
        broken[7][column] += 13
        got = batches.control(make("report_transformation_reconciliation", broken), june, name).filter("difference <> 0")
        assert [(r.batch_id, r.difference, r.balanced) for r in got.collect()] == [("b7", 13, False)]


def test_nulls_read_as_zero_or_spread(make, june):
    row = dict(batch_id="a", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), expected_reportable_txn=4)
    t = make("report_transformation_reconciliation", [row])
    assert one(batches.control(t, june, "reportable"))["difference"] == 4
    assert one(batches.batch_control_summary(t))["reportable_diff"] is None
    # A null side counts as a difference of four, or never counts.
    assert one(batches.recon_issue_counts(t, june))["reconciliation_issues"] == 1
    assert one(batches.recon_issue_counts(t, june, raw=True))["reconciliation_issues"] == 0


def test_duplicates_stay_out_of_the_primary_equation(make, june):
    row = dict(
        batch_id="a", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), activity_transformed=5,
        activity_transformation_failed=1, duplicate_transformation=2, actual_activity_eligible_for_transformation=6,
    )
    t = make("report_transformation_reconciliation", [row])
    assert one(batches.control(t, june, "transformation"))["difference"] == 0
    assert one(batches.control(t, june, "transformation_with_dup"))["difference"] == -2


def test_empty_period_gives_null_or_zero_as_named(make, june):
    t = make("report_transformation_reconciliation", [])
    assert one(batches.transformation_flow(t, june))["selected_for_processing"] is None
    assert one(validation.future_reporting(t, june)["summary"])["sum_lookback_txn"] == 0
    assert one(kpi.kpi_cards(t, june))["batches_run"] == 0
    assert rows_of(kpi.issues_by_type(t, june), "affected_batches") == [(0,)] * 4


def test_batches_are_counted_by_id_alone_as_the_cards_do(make, june):
    rows = [dict(batch_id="same", rpt_grp_id=g, seq_no=1, created_timestamp=at(2026, 6, 2)) for g in (1, 2)]
    got = one(kpi.kpi_cards(make("report_transformation_reconciliation", rows), june))
    assert (got["batches_run"], got["report_groups_run"]) == (1, 2)


def test_totals_cover_all_batches_however_short_the_list(make, june):
    rows = [
        dict(batch_id=f"b{i:03}", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), txn_selected=i + 1, lookback_txn=1)
        for i in range(60)
    ]
    t = make("report_transformation_reconciliation", rows)
    assert one(validation.selection_balance(t, june)["summary"])["unbalanced_batches"] == 60
    short = validation.selection_balance(t, june, k=5)
    assert one(short["summary"])["lookback_txn"] == 60 and short["top"].count() == 5
    assert validation.selection_balance(t, june)["top"].count() == 60


HEALTH = [
    ({}, {}, "Warning"),  # no operational row
    ({}, dict(batch_status="Generated"), "Healthy"),
    ({}, dict(batch_status="Failed"), "Failed"),
    ({}, dict(batch_status="Generated", report_status="FAILED"), "Failed"),
    ({}, dict(batch_status="Generated", compiler_status="Data Selection Failed"), "Failed"),
    ({}, dict(batch_status="In Progress"), "In Progress"),
    ({}, dict(batch_status="Generated", compiler_status="Data Transformation Started"), "In Progress"),
    (dict(expected_reportable_txn=1), dict(batch_status="Generated"), "Critical"),
    (dict(lookback_txn=1), dict(batch_status="Generated"), "Critical"),
    (dict(duplicate_transformation=1), dict(batch_status="Generated"), "Warning"),
    (dict(txn_missing_attempt_count=1), dict(batch_status="Generated"), "Warning"),
    (dict(expected_reportable_txn=1), dict(batch_status="Failed"), "Failed"),
]


def test_five_level_health(make, june):
    base = dict(rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2))
    recon = make("report_transformation_reconciliation", [dict(batch_id=str(i), **base, **r) for i, (r, _, _) in enumerate(HEALTH)])
    info = make("report_batch_info", [dict(batch_id=str(i), rpt_grp_id=1, seq_no=1, **s) for i, (_, s, _) in enumerate(HEALTH) if s])
    runs = kpi.with_batch_info(recon, info).withColumn("health", C.health_five_level())
    got = {int(r.batch_id): r.health for r in runs.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(HEALTH)}
    queue = batches.batch_investigation_queue(recon, info, june).collect()
    assert [r.health for r in queue][:4] == ["Failed"] * 4 and "Healthy" not in {r.health for r in queue}
