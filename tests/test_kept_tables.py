"""The whole reconciliation rows: the lines are joined once, and a row's texts and times become flags."""

from __future__ import annotations

import pytest

from tallyline.operators import transform as T
from tallyline.plans.registry import PLANS
from tests.conftest import at, one
from tests.test_transform import config, hit


@pytest.mark.parametrize("name", ["hits", "attempts", "journey", "batch_recon", "batch_info"])
def test_kept_tables_have_the_same_rows(tables, name):
    want, got = getattr(tables, name), getattr(tables.kept(), name)
    assert got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["build_batch_reconciliation__row", "build_batch_reconciliation__controls"])
def test_the_lines_are_joined_once(tables, name):
    text = PLANS[name](tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in text and "c_custkey" not in text


def test_a_window_without_a_start_counts_no_part_of_it(make):
    info = [dict(rpt_grp_id=1, batch_id="B", seq_no=1, txn_lookback_start_timestamp=at(2026, 6, 1), txn_end_timestamp=at(2026, 6, 14))]
    arrived = make("attempts_by_surrogate_key", [dict(attempt_id=1, txn_sur_key=None), dict(attempt_id=1, txn_sur_key="t"), dict(attempt_id=2, txn_sur_key=None)])
    rows = make("rule_hit", [hit(1, external_txn_key=1), hit(2, external_txn_key=2), hit(3, external_txn_key=3, is_reported=True)])
    keys = T.batch_keys(rows, arrived, config(make), T.batch_windows(make("report_batch_info", info)))
    # No text or time of a row is left to travel.
    assert not {"galactic_id", "mtcn", "exclusion_reason_id", "transaction_date", "created_timestamp", "txn_sur_key"} & set(keys.columns)
    got = one(T.build_batch_reconciliation(rows, arrived, config(make), T.batch_windows(make("report_batch_info", info))))
    assert (got["txn_selected"], got["expected_reportable_txn"], got["txn_missing_attempt_count"]) == (3, 1, 2)
    assert (got["lookback_txn"], got["reporting_period_txn"], got["activity_selected"]) == (0, 0, 0)
