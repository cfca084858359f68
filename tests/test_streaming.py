"""Streams over files that arrive in any order give what the batch operators give."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tallyline.operators import lifecycle as L
from tallyline.sources.sinks import UpsertLog
from tallyline.streaming import lifecycle as S
from tests.conftest import at, rows_of

DDL = "event_id BIGINT, ts TIMESTAMP, owner_sub STRING, case_id STRING, to_status STRING"


def source(spark, folder, files):
    """A file stream that reads one file per micro-batch in the order given."""
    import os

    for i, rows in enumerate(files):
        path = f"{folder}/in/part={i}"
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    shape = spark.createDataFrame([], DDL).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def events(n, seed, minutes=600):
    rnd = random.Random(seed)
    path = ["retrieving", "analyzing", "doc_analysis", "complete", "error"]
    out = []
    for i in range(n):
        case = f"c{rnd.randint(1, 25)}"
        out.append((i, at(2026, 6, 1) + timedelta(minutes=rnd.randint(0, minutes), seconds=i % 60), "o", case, rnd.choices(path, [4, 4, 4, 4, 1])[0]))
    return out


def cut(rows, n, mixed):
    """The rows in n files, in time order or mixed."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    if mixed:
        random.Random(n).shuffle(rows)
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("n", [1, 4, 16])
def test_streams_give_the_batch_answer_however_the_files_are_cut(spark, tmp_path, n, mixed):
    rows = events(160, 1)
    files = cut(rows, n, mixed)
    batch = spark.createDataFrame(rows, DDL)
    got = S.run_to_table(S.guarded_transitions(source(spark, tmp_path / "g", files), "2 days"), str(tmp_path / "g"), ("case_id",))
    cols = ("case_id", "status", "failed_stage", "accepted", "dropped")
    assert rows_of(got, *cols) == rows_of(L.guarded_transitions(batch), *cols)
    subs = lambda df: df.selectExpr("to_status AS idempotency_key", "case_id", "owner_sub", "ts AS created_at", "event_id")
    got = earliest_of(S.dedupe_submissions(subs(source(spark, tmp_path / "d", files)), "2 days", 60), tmp_path / "d", "idempotency_key")
    cols = ("idempotency_key", "case_id", "created_at")
    assert rows_of(got, *cols) == rows_of(L.dedupe_submissions(subs(batch)), *cols)
    done = lambda df: df.selectExpr("case_id", "to_status AS stage", "owner_sub AS output", "ts AS completed_at", "event_id")
    got = earliest_of(S.idempotent_stages(done(source(spark, tmp_path / "i", files)), "2 days", 90), tmp_path / "i", "case_id", "stage")
    cols = ("case_id", "stage", "output", "completed_at")
    assert rows_of(got, *cols) == rows_of(L.idempotent_stages(done(batch)), *cols)
    got = bursts_of(spark, S.sessions(source(spark, tmp_path / "s", files), delay="2 days"), tmp_path / "s")
    assert rows_of(got, "case_id", "started_at", "events", "closed_at") == bursts(rows)
    last = [[(10_000 + i, at(2026, 6, 9), "o", "end", "complete")] for i in range(2)]
    got = S.run_to_table(S.reap_stuck(source(spark, tmp_path / "r", files + last), delay="2 days"), str(tmp_path / "r"), ("case_id",))
    assert rows_of(got, "case_id", "failed_stage", "since") == stuck(rows)


def earliest_of(df, folder, *keys):
    return S.first_of(S.run_to_table(df, str(folder), (*keys, "window_start")), keys)


def bursts_of(spark, df, folder):
    S.run(df, str(folder), ("case_id", "started_at"), "append")
    return S.all_bursts(spark, str(folder))


def bursts(rows):
    out = []
    for case in {r[3] for r in rows}:
        mine: list[list] = []
        for t in sorted(r[1] for r in rows if r[3] == case):
            if mine and t < mine[-1][-1] + timedelta(minutes=10):
                mine[-1].append(t)
            else:
                mine.append([t])
        out += [(case, b[0], len(b), b[-1] + timedelta(minutes=10)) for b in mine]
    return sorted(out, key=str)


def stuck(rows):
    out = []
    for case in {r[3] for r in rows}:
        first = min(r[1] for r in rows if r[3] == case)
        mine = sorted((r[1], r[0], r[4]) for r in rows if r[3] == case and r[1] <= first + timedelta(minutes=15))
        if not any(s in L.TERMINAL for _, _, s in mine):
            out.append((case, mine[-1][2], first))
    return sorted(out, key=str)


def test_a_row_behind_the_watermark_is_lost(spark, tmp_path):
    t = at(2026, 6, 1, 12)
    newer = [[(i, t + timedelta(hours=9), "o", "z", "retrieving")] for i in (2, 3)]
    files = [[(1, t, "o", "a", "analyzing")], *newer, [(4, t - timedelta(minutes=1), "o", "a", "retrieving")]]
    got = S.run_to_table(S.guarded_transitions(source(spark, tmp_path, files)), str(tmp_path), ("case_id",))
    assert rows_of(got.filter("case_id = 'a'"), "status", "accepted", "dropped") == [("queued", 0, 1)]


def test_windowed_metrics_equal_the_batch_when_nothing_is_late(spark, tmp_path):
    rows = events(200, 2, 20_000)
    random.Random(3).shuffle(rows)
    got = S.run_to_table(S.metrics(source(spark, tmp_path, [rows[:70], rows[70:]]), delay="30 days"), str(tmp_path), ("window_start",))
    want = L.lifecycle_metrics(spark.createDataFrame(rows, DDL))
    assert rows_of(got, *want.columns) == rows_of(want)


def test_rows_behind_the_watermark_do_not_count(spark, tmp_path):
    old = (9, at(2026, 6, 1, 1), "o", "late", "retrieving")
    # The watermark of one micro-batch drops late rows from the one after the next.
    newer = [[(i, at(2026, 6, 9), "o", "a", "complete")] for i in (2, 3)]
    files = [[(1, at(2026, 6, 1, 1), "o", "a", "retrieving")], *newer, [old]]
    got = S.run_to_table(S.metrics(source(spark, tmp_path, files), delay="1 hour"), str(tmp_path), ("window_start",))
    assert rows_of(got.filter(F.col("window_start") < F.lit(at(2026, 6, 2))), "events") == [(1,)]


def test_first_submission_per_key_across_files(spark, tmp_path):
    files = [[(1, at(2026, 6, 1), "o", "a", "k1"), (2, at(2026, 6, 1), "o", "b", "k2")], [(3, at(2026, 6, 1, 2), "o", "c", "k1"), (4, at(2026, 6, 1, 3), "o", "d", "k3")]]
    subs = source(spark, tmp_path, files).selectExpr("to_status AS idempotency_key", "case_id", "ts AS created_at", "event_id")
    got = earliest_of(S.dedupe_submissions(subs), tmp_path, "idempotency_key")
    assert rows_of(got, "idempotency_key", "case_id") == [("k1", "a"), ("k2", "b"), ("k3", "d")]


def test_stuck_cases_time_out_by_event_time(spark, tmp_path):
    t = at(2026, 6, 1, 12)
    m = lambda k: t + timedelta(minutes=k)
    files = [
        [(1, m(0), "o", "stuck", "retrieving"), (2, m(0), "o", "fine", "retrieving")],
        [(3, m(5), "o", "fine", "complete"), (4, m(5), "o", "stuck", "analyzing")],
        [(5, m(40), "o", "young", "retrieving")],
        [(6, m(41), "o", "young", "analyzing")],
    ]
    got = S.run_to_table(S.reap_stuck(source(spark, tmp_path, files)), str(tmp_path), ("case_id",))
    assert rows_of(got, "case_id", "status", "failed_stage", "error_reason", "since") == [("stuck", "error", "analyzing", "TIMEOUT", m(0))]


def test_bursts_close_after_the_gap(spark, tmp_path):
    t = at(2026, 6, 1)
    rows = [(i, t + timedelta(minutes=k), "o", "a", "retrieving") for i, k in enumerate((0, 5, 9, 40))] + [(9, at(2026, 6, 3), "o", "z", "error")]
    got = bursts_of(spark, S.sessions(source(spark, tmp_path, [rows])), tmp_path)
    z = ("z", at(2026, 6, 3), 1)
    assert rows_of(got, "case_id", "started_at", "events") == [("a", t, 3), ("a", t + timedelta(minutes=40), 1), z]


def test_an_event_at_the_gap_starts_a_new_burst_and_closed_bursts_leave_the_state(spark, tmp_path):
    t = at(2026, 6, 1)
    rows = [(1, t, "o", "a", "retrieving"), (2, t + timedelta(minutes=10), "o", "a", "complete"), (3, t + timedelta(minutes=19), "o", "a", None)]
    later = [(4, at(2026, 6, 3), "o", "z", "error")]
    got = bursts_of(spark, S.sessions(source(spark, tmp_path, [rows, later])), tmp_path)
    a = [("a", t, 1, 0), ("a", t + timedelta(minutes=10), 2, 1)]
    assert rows_of(got, "case_id", "started_at", "events", "terminal_events") == [*a, ("z", at(2026, 6, 3), 1, 1)]
    assert rows_of(S.open_bursts(spark, str(tmp_path)), "case_id") == [("z",)]
    assert rows_of(S.table(spark, str(tmp_path), ("case_id", "started_at")), "case_id") == [("a",), ("a",)]


def test_a_key_seen_again_in_a_later_window_keeps_its_first_row(spark, tmp_path):
    files = [[(i, at(2026, 6, 1 + i), "o", f"c{i}", "k")] for i in (0, 3, 9)]
    subs = source(spark, tmp_path, files).selectExpr("to_status AS idempotency_key", "case_id", "ts AS created_at", "event_id")
    windows = S.run_to_table(S.dedupe_submissions(subs), str(tmp_path), ("idempotency_key", "window_start"))
    assert windows.count() == 3
    assert rows_of(S.first_of(windows, ("idempotency_key",)), "case_id") == [("c0",)]
    # The state holds only the windows that the watermark has not passed.
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() == 1


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    log = UpsertLog(str(tmp_path / "t"), ("k",))
    make = lambda *rows: spark.createDataFrame(rows, "k INT, v STRING")
    log.write(make((1, "a"), (2, "a")), 0)
    log.write(make((2, "b")), 1)
    log.write(make((2, "b")), 1)
    assert rows_of(log.read(spark)) == [(1, "a"), (2, "b")]
    small = log.compact(spark, str(tmp_path / "u"))
    small.write(make((1, "c")), 2)
    assert rows_of(small.read(spark)) == [(1, "c"), (2, "b")]


def test_processors_share_the_batch_operators_states():
    from tallyline.streaming import processors as p

    assert p.PATH == (L.START, *L.PATH)
    assert (p.FAILED, p.TERMINAL, p.TIMEOUT) == (L.FAILED, L.TERMINAL, L.TIMEOUT)


def test_processors_load_without_the_package():
    """A worker that cannot import the package can still unpickle the processors."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tallyline.streaming.processors import GuardedTransitions, Reaper

    sent = cloudpickle.dumps([GuardedTransitions(), Reaper(15, 60)])
    code = (
        "import pickle, sys\n"
        "got = pickle.loads(sys.stdin.buffer.read())\n"
        "assert not any(m.startswith('tallyline') for m in sys.modules)\n"
        "print(got[1].limit_us)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env=env, check=True, timeout=120)
    assert done.stdout.strip() == b"900000000"
