from __future__ import annotations

import random
from datetime import timedelta

import pytest

from tallyline.operators import lifecycle as L
from tests.conftest import at, rows_of

EVENTS = "case_id STRING, to_status STRING, ts TIMESTAMP, event_id INT"
ORDER = ["queued", "retrieving", "analyzing", "doc_analysis", "complete"]


def fold(events):
    """The state machine, written as a plain loop over ordered events."""
    state, was, taken = "queued", None, 0
    for to in events:
        if state in ("complete", "error"):
            continue
        if to == "error":
            was, state, taken = state, "error", taken + 1
        elif ORDER.index(to) == ORDER.index(state) + 1:
            state, taken = to, taken + 1
    return state, was, taken, len(events) - taken


@pytest.mark.parametrize("seed", range(4))
def test_guarded_transitions_equal_the_fold(frame, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        # One case holds a third of all events; the weights let some cases finish.
        case = "hot" if rnd.random() < 1 / 3 else f"c{rnd.randint(1, 60)}"
        to = rnd.choices([*ORDER[1:], "error"], [4, 4, 4, 4, 1])[0]
        rows.append((case, to, at(2026, 6, 1) + timedelta(minutes=rnd.randint(0, 300)), i))
    got = {r.case_id: (r.status, r.failed_stage, r.accepted, r.dropped) for r in L.guarded_transitions(frame(EVENTS, rows)).collect()}
    want = {}
    for case in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == case), key=lambda r: (r[2], r[3]))
        want[case] = fold([r[1] for r in mine])
    assert got == want


def test_every_prefix_of_the_path(frame):
    t0 = at(2026, 6, 1)
    rows = [(f"n{n}", s, t0 + timedelta(minutes=i), i) for n in range(1, 5) for i, s in enumerate(ORDER[1 : n + 1])]
    rows += [("late", "error", t0 + timedelta(hours=9), 99), ("late", "retrieving", t0, 1), ("done", "error", t0 + timedelta(hours=9), 99)]
    rows += [("done", s, t0 + timedelta(minutes=i), i) for i, s in enumerate(ORDER[1:])]
    got = {r.case_id: (r.status, r.failed_stage, r.dropped) for r in L.guarded_transitions(frame(EVENTS, rows)).collect()}
    assert got == {
        "n1": ("retrieving", None, 0), "n2": ("analyzing", None, 0), "n3": ("doc_analysis", None, 0), "n4": ("complete", None, 0),
        "late": ("error", "retrieving", 0), "done": ("complete", None, 1),
    }


def test_first_submission_claim_and_result_win(frame):
    s = frame("idempotency_key STRING, case_id STRING, owner_sub STRING, created_at TIMESTAMP, event_id INT", [("k", "b", "o", at(2026, 6, 2), 2), ("k", "a", "o", at(2026, 6, 1), 1), ("k", "c", "o", at(2026, 6, 1), 3)])
    assert rows_of(L.dedupe_submissions(s), "case_id", "submissions") == [("a", 3)]
    c = frame("case_id STRING, worker STRING, claimed_at TIMESTAMP, event_id INT", [("a", "w2", at(2026, 6, 1), 2), ("a", "w1", at(2026, 6, 1), 1)])
    assert rows_of(L.claim_cases(c), "claimed_by", "lost_claims") == [("w1", 1)]
    r = frame("case_id STRING, stage STRING, output STRING, completed_at TIMESTAMP, event_id INT", [("a", "analyzing", "second", at(2026, 6, 2), 2), ("a", "analyzing", "first", at(2026, 6, 1), 1)])
    assert rows_of(L.idempotent_stages(r), "output") == [("first",)]


CASES = "case_id STRING, owner_sub STRING, status STRING, failed_stage STRING, error_reason STRING, claimed_at TIMESTAMP, created_at TIMESTAMP"


def case(i, status="queued", claimed=None, created=None, owner="o"):
    return (i, owner, status, None, None, claimed, created or at(2026, 6, 1, 12))


def test_reaping_starts_after_the_limit_and_uses_creation_when_unclaimed(frame):
    now = at(2026, 6, 1, 12, 15)
    t = frame(
        CASES,
        [
            case("exact"), case("old", created=at(2026, 6, 1, 11, 59, 59)), case("claimed", "analyzing", claimed=at(2026, 6, 1, 12, 10), created=at(2026, 6, 1)),
            case("stuck", "analyzing", claimed=at(2026, 6, 1, 11), created=at(2026, 6, 1)), case("done", "complete", created=at(2026, 6, 1)),
        ],
    )
    assert rows_of(L.reap_stuck(t, now), "case_id", "failed_stage", "error_reason") == [("old", "queued", "TIMEOUT"), ("stuck", "analyzing", "TIMEOUT")]


def test_views(frame):
    t = frame(CASES, [case("a", "analyzing"), ("b", "o", "error", "analyzing", "boom", None, at(2026, 6, 1)), case("c", "complete")])
    r = frame("case_id STRING, stage STRING, output STRING, completed_at TIMESTAMP, event_id INT", [("a", "retrieving", "x", at(2026, 6, 1), 1), ("b", "retrieving", "y", at(2026, 6, 1), 2), ("c", "doc_analysis", "z", at(2026, 6, 1), 3), ("c", "retrieving", "w", at(2026, 6, 2), 4)])
    got = rows_of(L.case_status_view(t, r), "case_id", "current_stage", "completed_stages", "failed_stage", "error_reason")
    assert got == [("a", "analyzing", "retrieving", None, None), ("b", None, "retrieving", "analyzing", "boom"), ("c", None, "retrieving,doc_analysis", None, None)]
    assert rows_of(L.case_summary_view(t, r), "case_id", "retrieving_output", "doc_analysis_output", "is_partial") == [("b", "y", None, True), ("c", "w", "z", False)]


def test_pages_cover_all_cases_once_with_equal_times(frame):
    t = frame(CASES, [case(f"c{i:03}", created=at(2026, 6, 1, i % 3)) for i in range(23)] + [case("x", owner="other")])
    seen, cursor = [], None
    while True:
        page = L.list_cases(t, "o", cursor, 5).collect()
        seen += [r.case_id for r in page]
        if len(page) < 5:
            break
        cursor = (page[-1].created_at, page[-1].case_id)
    assert len(seen) == len(set(seen)) == 23 and seen == sorted(seen, key=lambda c: (int(c[1:]) % 3, c), reverse=True)
    assert L.list_cases(t).count() == 24
    for limit in (0, 51):
        with pytest.raises(ValueError):
            L.list_cases(t, limit=limit)


def test_cap_counts_active_cases_only(frame):
    rows = [case(f"a{i}", owner="a") for i in range(5)] + [case(f"b{i}", owner="b") for i in range(4)] + [case("b9", "complete", owner="b")]
    assert rows_of(L.active_case_cap(frame(CASES, rows))) == [("a", 5)]


def test_silence_is_judged_from_the_start(frame):
    t0 = at(2026, 6, 1)
    m = lambda k: t0 + timedelta(minutes=k)
    rows = [
        ("quick", "retrieving", m(0), 1), ("quick", "complete", m(10), 2), ("slow", "retrieving", m(0), 3), ("slow", "error", m(11), 4),
        ("silent", "retrieving", m(0), 5), ("fresh", "retrieving", m(95), 6),
    ]
    assert rows_of(L.silent_sessions(frame(EVENTS, rows), m(100)), "case_id") == [("silent",), ("slow",)]


ENTRIES = "session_id STRING, entry_id BIGINT, type STRING, data STRING, ts TIMESTAMP"


def entry(s, i, kind="chunk", data=None, minute=0):
    return (s, i, kind, data if data is not None or kind != "chunk" else f"{i},", at(2026, 6, 1, 0, minute))


def test_assembly_stops_at_the_first_end_and_orders_by_number(frame):
    rows = [entry("a", 10), entry("a", 2), entry("a", 11, "done"), entry("a", 12), entry("a", 13, "error"), entry("b", 1), entry("c", 1, "error", "x")]
    got = rows_of(L.assemble_stream(frame(ENTRIES, rows)), "session_id", "text", "status")
    assert got == [("a", "2,10,", "done"), ("b", "1,", "streaming")]


def test_a_long_session_comes_in_parts_that_make_up_the_whole(frame):
    rows = [entry("hot", i + 1) for i in range(1000)] + [entry(f"s{i}", 1) for i in range(500)]
    random.Random(2).shuffle(rows)
    got = L.assemble_stream(frame(ENTRIES, rows), part_entries=64).filter("session_id = 'hot'").orderBy("part_no").collect()
    assert max(r.chunks for r in got) == 64 and len(got) == 16
    assert "".join(r.text for r in got) == "".join(f"{i + 1}," for i in range(1000))


def test_resume_and_expiry(frame):
    t = frame(ENTRIES, [entry("a", 1), entry("a", 2, minute=1), entry("a", 3, "done", minute=2), entry("b", 1)])
    assert [r.entry_id for r in L.resume_from(t, "a", 1).collect()] == [2, 3]
    assert L.resume_from(t, "a").count() == 3
    keep = lambda now: rows_of(L.expire_streams(t, now), "session_id", "entry_id")
    assert len(keep(at(2026, 6, 1, 0, 16))) == 4
    assert keep(at(2026, 6, 1, 0, 17)) == [("a", 3), ("b", 1)]
    assert keep(at(2026, 6, 2)) == []


def test_tumbling_metrics(frame):
    rows = [("a", "retrieving", at(2026, 6, 1, 23, 59), 1), ("a", "error", at(2026, 6, 2), 2), ("b", "complete", at(2026, 6, 2, 5), 3)]
    got = rows_of(L.lifecycle_metrics(frame(EVENTS, rows)), "events", "retrieving", "complete", "error")
    assert got == [(1, 1, 0, 0), (2, 0, 1, 1)]


def test_one_case_with_most_events(frame, spark):
    """A case of 200,000 events over two months, dealt over its hours, against the plain loop."""
    from pyspark.sql import functions as F

    n = 200_000
    to = F.element_at(F.array(*map(F.lit, ["retrieving", "queued", "doc_analysis", "complete", "retrieving"])), (F.xxhash64("id") % 5 + 5).cast("int") % 5 + 1)
    rows = spark.range(n).select(
        F.lit("hot").alias("case_id"), F.when(F.col("id") == 150_000, "analyzing").when(F.col("id") == 199_999, "error").otherwise(to).alias("to_status"),
        F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") * 26).alias("ts"), F.col("id").alias("event_id"),
    )
    want = fold([r.to_status for r in rows.orderBy("event_id").collect()])
    got = L.guarded_transitions(rows.repartition(7, "ts")).collect()
    assert [(r.status, r.failed_stage, r.accepted, r.dropped) for r in got] == [want]
    per_hour = L.transition_maps(rows).agg(F.max("events"), F.count("*")).first()
    assert per_hour[0] <= 140 and per_hour[1] > 1400


def test_a_case_is_read_once(tables):
    plan = L.guarded_transitions(tables.case_events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_next_cursor(frame):
    rows = [(f"c{i}", "u", "queued", at(2026, 6, 1 + i // 2)) for i in range(5)]
    t = frame("case_id STRING, owner_sub STRING, status STRING, created_at TIMESTAMP", rows)
    seen, cursor = [], None
    while True:
        page = L.list_cases(t, cursor=cursor, limit=2)
        seen += [r.case_id for r in page.collect()]
        last = L.next_cursor(page, 2).collect()
        if not last:
            break
        cursor = tuple(last[0])
    assert seen == ["c4", "c3", "c2", "c1", "c0"]


def test_created_cases_count_once_per_key(frame):
    rows = [("a", "retrieving", at(2026, 6, 1), 1), ("a", None, at(2026, 6, 1), 2)]
    sent = [("k", "a", "u", at(2026, 6, 1), 1), ("k", "b", "u", at(2026, 6, 2), 2), ("l", "c", "u", at(2026, 6, 3), 3)]
    subs = frame("idempotency_key STRING, case_id STRING, owner_sub STRING, created_at TIMESTAMP, event_id INT", sent)
    got = rows_of(L.lifecycle_metrics(frame(EVENTS, rows), submissions=subs), "window_start", "events", "created", "retrieving")
    assert got == [(at(2026, 6, 1), 2, 1, 1), (at(2026, 6, 3), 0, 1, 0)]
