"""Streams whose parts a reader puts together: case states and time-outs run in the JVM, part by part."""

from __future__ import annotations

from datetime import timedelta

import pytest

from tallyline.operators import lifecycle as L
from tallyline.streaming import lifecycle as S
from tests.conftest import at, rows_of
from tests.test_streaming import DDL, source

T = at(2026, 6, 1, 12)


def m(k):
    return T + timedelta(minutes=k)


@pytest.mark.parametrize("build", [S.guarded_transitions, S.reap_stuck])
def test_no_python_runs_for_a_case(spark, tmp_path, build):
    plan = build(source(spark, tmp_path, [[(1, T, "o", "a", "retrieving")]])).rows._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan
    assert "Python" not in plan and "Pandas" not in plan and "TransformWithState" not in plan


def test_a_bucket_put_out_twice_counts_once_and_leaves_the_state(spark, tmp_path):
    files = [
        [(1, m(0), "o", "a", "retrieving"), (2, m(70), "o", "a", "doc_analysis"), (3, None, "o", "b", "retrieving"), (4, m(1), "o", None, "error")],
        [(5, m(10), "o", "a", "analyzing"), (6, m(5), "o", "b", "analyzing"), (7, m(80), "o", "a", None)],
        [(8, at(2026, 6, 9), "o", "z", "complete")],
    ]
    got = S.run_to_table(S.guarded_transitions(source(spark, tmp_path, files), "2 days"), str(tmp_path), ("case_id", "bucket"))
    cols = ("case_id", "status", "failed_stage", "accepted", "dropped")
    assert rows_of(got, *cols) == rows_of(L.guarded_transitions(spark.createDataFrame(sum(files, []), DDL)), *cols)
    assert rows_of(got.filter("case_id = 'a'"), *cols) == [("a", "doc_analysis", None, 3, 1)]
    # The last file's row and the row without a time wait.
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() == 2


def test_map_numbers_equal_the_batch_maps(spark):
    kinds = ["retrieving", "analyzing", "doc_analysis", "complete", "error", "other"]
    rows = [(100 * i + 10 * j + k, m(j), "o", f"c{i}", kinds[(i + s) % 6]) for i in range(36) for j, (k, s) in enumerate(((0, 0), (1, i // 6), (2, i // 3)))]
    events = spark.createDataFrame(rows, DDL)
    per = events.selectExpr("case_id", "ts", "event_id", "to_status").withColumn("step", L.event_steps())
    parts = per.groupBy("case_id").agg(L.F.collect_list(L.F.struct("ts", "event_id", "step")).alias("held"))
    parts = parts.select("case_id", L.F.lit(T).alias("bucket"), L.F.lit(0).alias("_seq"), L.map_number("held").alias("number"), L.F.size("held").cast("bigint").alias("events"))
    cols = ("case_id", "status", "failed_stage", "accepted", "dropped")
    assert rows_of(L.case_states(parts), *cols) == rows_of(L.guarded_transitions(events), *cols)


def test_time_outs_reach_into_the_next_bucket_only_up_to_the_limit(spark, tmp_path):
    files = [
        [(1, m(14), "o", "ended", "retrieving"), (2, m(29), "o", "ended", "complete"), (3, m(14), "o", "late", "retrieving"), (4, m(30), "o", "late", "complete")],
        [(5, m(20), "o", "late", "analyzing"), (6, m(40), "o", "late", "error"), (7, m(3), "o", "gap", "retrieving"), (8, m(33), "o", "gap", "complete")],
        [(9, None, "o", "timeless", "analyzing"), (10, m(1), "o", "timeless", "complete"), (11, m(2), "o", None, "retrieving"), (12, m(120), "o", "young", "error")],
    ]
    got = S.run_to_table(S.reap_stuck(source(spark, tmp_path, files), delay="2 days"), str(tmp_path), ("case_id", "bucket"))
    want = [(None, "retrieving", m(2)), ("gap", "retrieving", m(3)), ("late", "analyzing", m(14)), ("timeless", "analyzing", None)]
    assert rows_of(got, "case_id", "failed_stage", "since") == sorted(want, key=str)
