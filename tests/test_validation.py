from __future__ import annotations

import random
from datetime import timedelta

from tallyline.functions import markers as M
from tallyline.operators import bridges, journey, validation
from tallyline.operators.ranges import join_windows
from tests.conftest import at, one, rows_of


def j(n, stage, status, **kw):
    return dict(
        rpt_grp_id=1, batch_id="B", identifier=str(n), stage=stage, status=status, created_timestamp=at(2026, 6, 2),
        modified_timestamp=at(2026, 6, 3), **kw,
    )


def test_reason_categories_first_match_wins(make):
    t = make(
        "record_transformation_journey",
        [
            j(1, "transaction_join", "error"),
            j(2, "TRANSACTION_JOIN", "SUCCESS", skip_reason="Attempt 9 NOT yet Recorded"),
            j(3, "TRANSFORMATION", "Failed", skip_reason="why"),
            j(4, "FILTRATION", "SUCCESS", skip_reason="kept out"),
            j(5, "FILTRATION", None),
            j(6, "FILTRATION", "SUCCESS", skip_reason=""),
            j(7, "TRANSFORMATION", "SUCCESS"),
        ],
    )
    got = {(r.stage.upper(), r.reason_category): r.affected_transactions for r in journey.failure_reasons(t).collect()}
    assert got[("FILTRATION", "OTHER_SKIP_REASON")] == 1 and got[("FILTRATION", "OTHER_FAILURE")] == 2
    assert got[("TRANSFORMATION", "TRANSFORMATION_FAILURE")] == 1
    rows = journey.attempt_not_received(t)
    assert rows_of(rows, "identifier") == [("1",), ("2",)]


def test_markers_are_exact_and_accept_any_system(make):
    t = make(
        "record_transformation_journey",
        [
            j(1, "FILTRATION", "EXCLUDED", comments="EXCLUDED_BECAUSE_ALREADY_REPORTED(ONE)"),
            j(2, "FILTRATION", "EXCLUDED", comments="EXCLUDED_BECAUSE_ALREADY_REPORTED(TWO)"),
            j(3, "FILTRATION", "EXCLUDED", comments="EXCLUDED_BECAUSE_ALREADY_REPORTED"),
            j(4, "TRANSFORMATION", "FAILURE", comments="OTHER"),
        ],
    )
    assert t.filter(M.already_reported()).count() == 2
    assert rows_of(t.filter(M.already_reported("TWO")), "identifier") == [("2",)]
    assert (t.filter(M.failed()).count(), t.filter(M.failed(skipped_only=True)).count()) == (1, 0)


def test_journey_counts_against_metrics(make, june):
    recon = make(
        "report_transformation_reconciliation",
        [
            dict(batch_id="B", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), already_reported_count=2),
            dict(batch_id="C", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), already_reported_count=3),
            dict(batch_id="D", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2)),
        ],
    )
    mark = dict(comments="EXCLUDED_BECAUSE_ALREADY_REPORTED(X)")
    t = make("record_transformation_journey", [j(1, "FILTRATION", "EXCLUDED", **mark), j(2, "FILTRATION", "EXCLUDED", **mark)])
    got = validation.already_reported(recon, t, june)
    s = one(got["summary"])
    assert (s["total_batches"], s["batches_with_any_journey"], s["already_reported_metric_nonzero"]) == (3, 1, 2)
    assert (s["already_reported_balanced"], s["already_reported_metric_without_marker"]) == (2, 1)
    assert rows_of(got["mismatches"], "batch_id") == [("C",)]


def test_report_generation_treats_a_null_status_as_not_completed(make, june):
    recon = make(
        "report_transformation_reconciliation",
        [dict(batch_id="B", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2), actual_reportable_txn=1)],
    )
    t = make("record_transformation_journey", [j(1, "REPORT_GENERATION", "GENERATED"), j(1, "REPORT_GENERATION", "GENERATED")])
    s = one(validation.report_generation(recon, t, make("report_batch_info", []), june)["summary"])
    assert (s["exact_match_batches"], s["generated_but_not_completed"], s["completed_with_zero_generated"]) == (1, 1, 0)


def test_root_cause_stays_inside_group_and_batch(make):
    t = make("record_transformation_journey", [j(1, "TRANSFORMATION", "SUCCESS", mtcn="m"), j(2, "FILTRATION", "EXCLUDED", mtcn="z")])
    hit = dict(rpt_grp_id=1, mtcn="m", efile_batch_id="B", external_txn_key=9, rule_id="R1", attempt_id=1, bucket_id=0)
    hits = make(
        "rule_hit",
        [
            hit, hit | dict(rule_id="R7", attempt_id=2),
            hit | dict(efile_batch_id="OTHER", attempt_id=3),
            hit | dict(rpt_grp_id=2, attempt_id=4),
            hit | dict(mtcn="q", external_txn_key=2, attempt_id=5),
        ],
    )
    audit = make("rule_hit_exclusion_audit", [dict(rpt_grp_id=1, processing_batch_id="B", mtcn="z", external_txn_key=7, exclusion_reason_id="why")])
    got = {r.identifier: r for r in journey.txn_root_cause(t, hits, audit).collect()}
    assert (got["1"].bridge, got["1"].rule_hit_rows, got["1"].first_rule_id, got["1"].last_rule_id) == ("mtcn", 2, "R1", "R7")
    assert (got["2"].bridge, got["2"].rule_hit_rows) == ("identifier", 1)
    assert (got["1"].audit_rows, got["2"].audit_rows, got["2"].audit_exclusion_reason) == (0, 1, "why")


def recon_row(**kw):
    row = dict(
        rpt_grp_id=1, run_date=20260615, seq_no=1, rpt_grp_name="g", created_timestamp=at(2026, 6, 16),
        data_selection_start_date=at(2026, 6, 1, 8), data_selection_end_date=at(2026, 6, 3, 8),
        distinct_rule_hits_count_source=1, distinct_rule_hits_count_target=0, missed_rule_hits_count_target=1,
    )
    return row | kw


def test_an_empty_window_counts_zero_or_one(make, june):
    recon, hits = make("rule_hit_reconciliation", [recon_row()]), make("rule_hit", [])
    safe = one(bridges.missed_definition_candidates(recon, hits, june)["rows"])
    assert safe["missed_is_reported_not_true"] == 0 and safe["distinct_rule_hit_keys"] == 0
    old = one(bridges.missed_definition_candidates(recon, hits, june, null_safe=False)["rows"])
    assert old["distinct_rule_hit_keys"] == old["missed_is_reported_not_true"] == old["missed_reporting_timestamp_null"] == 1
    assert old["rule_hit_rows"] == old["missed_is_reported_false"] == old["matched_true_all"] == 0
    assert old["variance_missed_reporting_timestamp_null"] == 0


def test_window_bounds_are_closed(make, june):
    recon = make("rule_hit_reconciliation", [recon_row()])
    times = [at(2026, 6, 1, 7, 59), at(2026, 6, 1, 8), at(2026, 6, 2), at(2026, 6, 3, 8), at(2026, 6, 3, 8, 0, 1)]
    hits = make("rule_hit", [dict(rpt_grp_id=1, rule_id="R", attempt_id=i, external_txn_key=i, transaction_date=t) for i, t in enumerate(times)])
    assert one(bridges.missed_definition_candidates(recon, hits, june)["rows"])["rule_hit_rows"] == 3
    found = one(bridges.locate_recon_detail(recon, hits, 1, 20260615)["summary"])
    assert (found["all_rule_hit_rows"], found["by_transaction_date"], found["by_created_timestamp"]) == (5, 3, 0)


def test_window_join_equals_brute_force_with_overlapping_windows(spark):
    rnd = random.Random(5)
    facts = [(rnd.randint(1, 2), i, at(2026, 6, rnd.randint(1, 28), rnd.randint(0, 23))) for i in range(300)]
    # A third of the facts share one moment.
    facts += [(1, 1000 + i, at(2026, 6, 10, 12)) for i in range(150)]
    wins = []
    for w in range(12):
        a = at(2026, 6, rnd.randint(1, 20), rnd.randint(0, 23))
        wins.append((rnd.randint(1, 2), w, a, at(2026, 6, rnd.randint(1, 28), 5)))
    f = spark.createDataFrame(facts, "g INT, i INT, ts TIMESTAMP")
    w = spark.createDataFrame(wins, "g INT, w INT, a TIMESTAMP, b TIMESTAMP")
    got = rows_of(join_windows(f, w, ("g",), "ts", "a", "b"), "i", "w")
    want = sorted([(i, n) for g, i, t in facts for h, n, a, b in wins if g == h and a <= t <= b], key=str)
    assert got == want and len(got) > 300


def test_transaction_bridge_with_a_hot_customer_number(make, june):
    """Half of a batch shares one customer number: the result is exact and nothing multiplies."""
    recon = make("report_transformation_reconciliation", [dict(batch_id="B", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2))])
    jt = [j(i, "S", "X", mtcn="hot" if i < 200 else f"m{i}") for i in range(400)]
    hits = [
        dict(rpt_grp_id=1, efile_batch_id="B", external_txn_key=i, mtcn="hot" if i < 200 else f"m{i}", attempt_id=i, rule_id="R", bucket_id=0)
        for i in range(300)
    ]
    got = bridges.txn_bridge_candidates(recon, make("record_transformation_journey", jt), make("rule_hit", hits), june)["summary"]
    by = {r.candidate.split(" ")[0]: tuple(r)[1:] for r in got.collect()}
    assert by["journey.mtcn"] == (300, 100, 200)
    assert by["journey.identifier"] == (300, 300, 0)
    assert by["txn_metadata.txn_sur_key"] == (0, 0, 0)


def test_batch_ids_of_different_types_meet_as_text(make, june):
    recon = make("report_transformation_reconciliation", [dict(batch_id="12", rpt_grp_id=1, seq_no=1, created_timestamp=at(2026, 6, 2))])
    hits = make("rule_hit", [dict(rpt_grp_id=1, batch_id=12, efile_batch_id="B-1", attempt_id=1)])
    got = {r.candidate_bridge: r.matched_rows for r in bridges.batch_bridge_candidates(recon, hits, make("rule_hit_exclusion_audit", []), june).collect()}
    assert got["rule_hit.batch_id"] == 1 and got["rule_hit.efile_batch_id"] == 0 and len(got) == 5


def test_aligned_intervals_make_up_a_window(frame):
    from tallyline.operators.ranges import BITS, interval_cover
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    rows = [(a, a + rnd.choice([-1, 0, 1, 30, 31, 32, 33, 63, 64, 1023, 1024, 5000, 40_000])) for a in (rnd.randint(-3000, 3000) for _ in range(300))]
    rows.append((20_000, 2_932_896))  # to the year 9999
    for first, last, cover in frame("a INT, b INT", rows).select("a", "b", interval_cover(F.col("a"), F.col("b"))).collect():
        days = sorted((c << (BITS * n), (c + 1) << (BITS * n)) for n, c in cover)
        assert [d[0] for d in days[1:]] == [d[1] for d in days[:-1]]
        assert (days[0][0], days[-1][1]) == (first, last + 1) if first <= last else not days
        assert len(cover) <= 4 * 62 + 3


def test_windows_without_an_end(frame):
    """Long and short windows against all pairs; the facts lie on the bounds, too."""
    rnd = random.Random(6)
    windows = [(i % 3, f"w{i}", at(2020, 1, 1) + timedelta(hours=rnd.randint(0, 40_000)), rnd.choice([1, 50, 3000, None])) for i in range(60)]
    windows = [(g, w, a, at(9999, 12, 31) if n is None else a + timedelta(hours=n)) for g, w, a, n in windows]
    facts = [(i % 4, i, rnd.choice([w[2] for w in windows]) + timedelta(hours=rnd.choice([-1, 0, 1, 700]))) for i in range(400)]
    w = frame("g INT, w STRING, a TIMESTAMP, b TIMESTAMP", [*windows, (0, "none", None, at(2021, 1, 1)), (0, "back", at(2021, 1, 1), at(2020, 1, 1))])
    f = frame("g INT, i INT, ts TIMESTAMP", [*facts, (0, 999, None)])
    got = rows_of(join_windows(f, w, ("g",), "ts", "a", "b"), "i", "w")
    assert sorted(got) == sorted((i, n) for g, i, t in facts for k, n, a, b in windows if g == k and a <= t <= b)
