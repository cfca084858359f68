from __future__ import annotations

import pytest

from tallyline.operators import kpi
from tallyline.operators import transform as T
from tallyline.operators.filters import Filters, filtered_batches, filtered_recon
from tests.conftest import at, one, rows_of
from tests.test_transform import config, hit

RECON = "report_transformation_reconciliation"


@pytest.fixture
def given(make):
    """Three batches; the failed one's older snapshot was fine, and a hit without a batch is bridged to none."""
    made = dict(created_timestamp=at(2026, 6, 2), modified_timestamp=at(2026, 6, 2))
    recon = make(
        RECON,
        [
            dict(batch_id="a", rpt_grp_id=1, seq_no=1, activity_transformation_failed=0, **made),
            dict(batch_id="a", rpt_grp_id=1, seq_no=2, activity_transformation_failed=4, **made),
            dict(batch_id="b", rpt_grp_id=1, seq_no=1, duplicate_transformation=2, **made),
            dict(batch_id="a", rpt_grp_id=2, seq_no=1, **made),
        ],
    )
    return recon, dict(
        batch_info=make(
            "report_batch_info",
            [
                dict(rpt_grp_id=1, batch_id="a", seq_no=1, batch_status="Generated"),
                dict(rpt_grp_id=1, batch_id="a", seq_no=2, batch_status="Failed"),
                dict(rpt_grp_id=1, batch_id="b", seq_no=1, batch_status="Generated"),
                dict(rpt_grp_id=2, batch_id="a", seq_no=1),
            ],
        ),
        hits=make(
            "rule_hit",
            [
                hit(1, efile_batch_id="a", rule_id="R1", source="X"), hit(2, efile_batch_id="b", rule_id="R1", source="Y"),
                hit(3, efile_batch_id="b", rule_id="R2", source="X"), hit(4, rpt_grp_id=2, rule_id="R1", source="X"),
            ],
        ),
        journey=make("record_transformation_journey", [dict(rpt_grp_id=2, batch_id="a", identifier="7", stage="FILTRATION")]),
        config=make("report_group_config", [dict(rpt_grp_id=1, country_name="C"), dict(rpt_grp_id=3, country_name="D")]),
    )


@pytest.mark.parametrize(
    "wanted, left",
    [
        ({}, [(1, "a"), (1, "b"), (2, "a")]),
        ({"rpt_grp_id": 1}, [(1, "a"), (1, "b")]),
        ({"batch_id": "a"}, [(1, "a"), (2, "a")]),
        # The older snapshot's status does not bring the batch back.
        ({"batch_status": "Generated"}, [(1, "b")]),
        ({"issue_type": "TRANSFORMATION_FAILURE"}, [(1, "a")]),
        ({"issue_type": "DUPLICATE_TRANSFORMATION"}, [(1, "b")]),
        ({"stage": "FILTRATION"}, [(2, "a")]),
        ({"country": "C"}, [(1, "a"), (1, "b")]),
        ({"rule_id": "R1"}, [(1, "a"), (1, "b")]),
        # One hit has to meet both.
        ({"rule_id": "R1", "source": "X"}, [(1, "a")]),
        ({"mtcn": "M2"}, [(1, "b")]),
        ({"external_txn_key": 4}, []),
        ({"galactic_id": "G3", "batch_status": "Generated"}, [(1, "b")]),
        ({"country": "C", "stage": "FILTRATION"}, []),
    ],
)
def test_each_filter_removes_what_it_should(given, june, wanted, left):
    recon, others = given
    assert rows_of(filtered_batches(recon, june, Filters(**wanted), **others), "rpt_grp_id", "batch_id") == left


def test_a_filter_needs_its_table_and_a_known_issue(given, june):
    with pytest.raises(ValueError, match="journey"):
        filtered_batches(given[0], june, Filters(stage="FILTRATION"))
    with pytest.raises(ValueError, match="unknown issue"):
        Filters(issue_type="NONE")


def test_headline_figures_of_filtered_and_of_no_batches(given, june, make):
    recon, others = given
    assert one(kpi.kpi_cards(filtered_batches(recon, june, Filters(country="C"), **others), june))["transformation_failures"] == 4
    assert one(kpi.kpi_cards(filtered_batches(recon, june, Filters(country="?"), **others), june))["batches_run"] == 0
    hit_recon = make("rule_hit_reconciliation", [dict(rpt_grp_id=1, run_date=20260601), dict(rpt_grp_id=3, run_date=20260601)])
    assert rows_of(filtered_recon(hit_recon, Filters(country="D", rule_id="R1"), config=others["config"]), "rpt_grp_id") == [(3,)]


def test_whole_rows_from_raw_hits(make):
    info = make(
        "report_batch_info",
        [
            dict(rpt_grp_id=g, batch_id="B", seq_no=1, txn_lookback_start_timestamp=at(2026, 6, 1), txn_start_timestamp=at(2026, 6, 8), txn_end_timestamp=at(2026, 6, 14))
            for g in (1, 2)
        ],
    )
    hits = [
        hit(1, external_txn_key=1, transaction_date=at(2026, 6, 2)),  # lookback, transformed
        hit(2, external_txn_key=2, rule_id="R1"), hit(3, external_txn_key=2, rule_id="R2"),  # two keys of one transaction
        hit(4, external_txn_key=3), hit(5, external_txn_key=3),  # the latest attempt has not arrived
        hit(6, external_txn_key=4),  # failed
        hit(7, external_txn_key=5, reporting_timestamp=at(2026, 6, 10)),  # reported before its creation day, no journey
        hit(8, external_txn_key=6),  # failed at first, then transformed
        hit(9, rpt_grp_id=2),
    ]
    arrived = make("attempts_by_surrogate_key", [dict(attempt_id=i, txn_sur_key="t") for i in (1, 2, 3, 4, 6, 7, 8, 9)])
    states = [("1", "SUCCESS"), ("2", "SUCCESS"), ("2", "SUCCESS"), ("3", "SUCCESS"), ("4", "FAILURE"), ("6", "FAILURE"), ("6", "SUCCESS")]
    journey = make("record_transformation_journey", [dict(rpt_grp_id=1, batch_id="B", identifier=k, stage="TRANSFORMATION", status=s) for k, s in states])
    stored = make(RECON, [dict(rpt_grp_id=1, batch_id="B", seq_no=n) for n in (1, 4)])
    cfg = config(make, g1="TRANSACTION_PER_RULE")
    out = T.batch_reconciliation_rows(make("rule_hit", hits), arrived, cfg, T.batch_windows(info), journey, stored, at(2026, 7, 1))
    assert out.schema.fieldNames() == stored.schema.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in stored.schema]
    first, second = sorted((r.asDict() for r in out.collect()), key=lambda r: r["rpt_grp_id"])
    assert first == dict(
        batch_id="B", seq_no=5, rpt_grp_id=1, rpt_grp_name=None, rpt_look_back_date="2026-06-01", rpt_from_date="2026-06-08", rpt_to_date="2026-06-14",
        txn_selected=7, txn_simulated=0, excluded_txn=0, txn_missing_attempt_count=0, already_reported_count=0, expected_reportable_txn=7,
        actual_reportable_txn=6, lookback_txn=1, lookback_future_reporting_txn=0, lookback_actual_txn=1, reporting_period_txn=6,
        reporting_period_future_reporting_txn=1, reporting_period_actual_txn=5, activity_selected=7, activity_missing=1, activity_simulated=0,
        expected_activity_eligible_for_transformation=6, actual_activity_eligible_for_transformation=5, activity_transformed=4,
        activity_transformation_failed=1, duplicate_transformation=1, created_timestamp=at(2026, 7, 1), modified_timestamp=at(2026, 7, 1),
        soft_dedup_dropped_txn_count=1,
    )
    # Never stored, no configuration, no journey.
    assert (second["seq_no"], second["txn_selected"], second["activity_transformed"], second["expected_activity_eligible_for_transformation"]) == (1, 1, 0, 1)
    assert T.batch_reconciliation_rows(make("rule_hit", []), arrived, cfg, T.batch_windows(info), journey, stored, at(2026, 7, 1)).count() == 0
