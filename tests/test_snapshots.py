from __future__ import annotations

from datetime import date

from tallyline.functions.period import Period, as_run_date, narrow, previous_month, previous_week
from tallyline.operators.snapshots import latest, latest_batch, latest_recon, latest_stage, upsert_latest
from tallyline.plans.registry import callables
from tests.conftest import DATA, at, rows_of


def test_previous_week_is_monday_to_sunday():
    assert previous_week(date(2026, 8, 18)) == Period(date(2026, 8, 10), date(2026, 8, 16))
    assert previous_week(date(2026, 8, 17)) == Period(date(2026, 8, 10), date(2026, 8, 16))
    assert previous_week(date(2026, 8, 16)) == Period(date(2026, 8, 3), date(2026, 8, 9))


def test_previous_month_and_run_date():
    assert previous_month(date(2026, 3, 31)) == Period(date(2026, 2, 1), date(2026, 2, 28))
    assert previous_month(date(2026, 1, 1)) == Period(date(2025, 12, 1), date(2025, 12, 31))
    assert as_run_date(date(2026, 7, 5)) == 20260705


def batch(make, *rows):
    return make("report_transformation_reconciliation", list(rows))


def test_period_is_half_open_on_timestamps(make, june):
    df = batch(
        make,
        dict(batch_id="a", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 30, 23, 59, 59)),
        dict(batch_id="b", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 7, 1)),
        dict(batch_id="c", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 1)),
        dict(batch_id="d", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 5, 31, 23, 59)),
    )
    assert rows_of(latest_batch(df, june), "batch_id") == [("a",), ("c",)]


def test_latest_prefers_seq_then_modified_and_nulls_are_oldest(make, june):
    day = at(2026, 6, 5)
    df = batch(
        make,
        dict(batch_id="a", rpt_grp_id=1, seq_no=2, created_timestamp=day, modified_timestamp=None, txn_selected=1),
        dict(batch_id="a", rpt_grp_id=1, seq_no=2, created_timestamp=day, modified_timestamp=at(2026, 6, 6), txn_selected=2),
        dict(batch_id="a", rpt_grp_id=1, seq_no=1, created_timestamp=day, modified_timestamp=at(2026, 6, 9), txn_selected=3),
        # The same batch id in another group is another batch.
        dict(batch_id="a", rpt_grp_id=2, seq_no=1, created_timestamp=day, txn_selected=4),
    )
    assert rows_of(latest_batch(df, june), "rpt_grp_id", "txn_selected") == [(1, 2), (2, 4)]


def test_a_later_snapshot_outside_the_period_does_not_hide_the_one_inside(make, june):
    df = batch(
        make,
        dict(batch_id="a", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 5)),
        dict(batch_id="a", rpt_grp_id=1, seq_no=2, created_timestamp=at(2026, 7, 5)),
    )
    assert rows_of(latest_batch(df, june), "seq_no") == [(1,)]
    assert rows_of(latest_batch(df, None), "seq_no") == [(2,)]


def test_recon_period_uses_the_integer_date_or_the_chosen_anchor(make, june):
    df = make(
        "rule_hit_reconciliation",
        [
            dict(rpt_grp_id=1, run_date=20260630, seq_no=1, created_timestamp=at(2026, 7, 2)),
            dict(rpt_grp_id=1, run_date=20251217, seq_no=1, created_timestamp=at(2026, 6, 15)),
        ],
    )
    assert rows_of(latest_recon(df, june), "run_date") == [(20260630,)]
    assert rows_of(latest_recon(df, june, anchor="created_timestamp"), "run_date") == [(20251217,)]


def test_stage_state_is_kept_per_stage_and_group(make):
    df = make(
        "record_transformation_journey",
        [
            dict(rpt_grp_id=1, batch_id="a", identifier="t", stage="FILTRATION", status="OLD", modified_timestamp=at(2026, 6, 1)),
            dict(rpt_grp_id=1, batch_id="a", identifier="t", stage="FILTRATION", status="NEW", modified_timestamp=at(2026, 6, 2)),
            dict(rpt_grp_id=1, batch_id="a", identifier="t", stage="TRANSFORMATION", status="X", modified_timestamp=at(2026, 6, 1)),
            dict(rpt_grp_id=2, batch_id="a", identifier="t", stage="FILTRATION", status="Y", modified_timestamp=at(2026, 6, 1)),
        ],
    )
    assert rows_of(latest_stage(df), "rpt_grp_id", "status") == [(1, "NEW"), (1, "X"), (2, "Y")]


def test_upsert_replaces_by_key_and_keeps_the_rest(frame):
    ddl = "k INT, v STRING, modified_timestamp TIMESTAMP"
    old = frame(ddl, [(1, "old", at(2026, 6, 9)), (2, "stays", at(2026, 6, 9))])
    new = frame(ddl, [(1, "first", at(2026, 6, 1)), (1, "second", at(2026, 6, 2)), (3, "added", None)])
    assert rows_of(upsert_latest(old, new, ("k",)), "k", "v") == [(1, "second"), (2, "stays"), (3, "added")]


def test_ties_fall_to_the_greatest_of_the_other_columns(frame):
    ddl = "k INT, seq_no INT, modified_timestamp TIMESTAMP, v STRING, w INT"
    rows = [(1, 2, None, "a", 9), (1, 2, None, "b", 1), (1, 2, None, "b", 3), (1, 1, None, "z", 9)]
    for given in (rows, rows[::-1]):
        assert rows_of(latest(frame(ddl, given).repartition(3), ("k",)), "v", "w") == [("b", 3)]


def test_optional_filters(frame):
    df = frame("a INT, b STRING", [(1, "x"), (2, "y")])
    assert narrow(df, a=None, b=None).count() == 2
    assert rows_of(narrow(df, a=2)) == [(2, "y")]


def test_latest_limits_rows_before_the_shuffle(tables, june):
    text = latest_batch(tables.batch_recon, june)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_period_reaches_the_scan(tables):
    p = Period(date(1996, 6, 1), date(1996, 9, 30))
    df = tables.hits.filter(p.holds("transaction_date"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-06-01" in text


def test_opt_without_arguments_keeps_every_row(spark, tables):
    got = callables()["opt"](spark, DATA)
    assert rows_of(got) == rows_of(tables.batch_recon, "rpt_grp_id", "batch_id", "seq_no")
    assert got.select("rpt_grp_id").distinct().count() > 1
