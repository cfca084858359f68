"""The registered time-outs do not depend on how the events fell into files and micro-batches."""

from __future__ import annotations

import functools
import os
import random
from datetime import timedelta

import duckdb
import pandas as pd
import pytest

from tallyline.plans.oracle import oracle
from tallyline.plans.registry import callables
from tallyline.streaming import lifecycle as S
from tests.conftest import DATA, at, rows_of
from tests.test_streaming import source

COLUMNS = ("case_id", "status", "failed_stage", "error_reason", "since")


def busy() -> pd.DataFrame:
    """The events of the smallest data set and cases that end or start a few minutes apart."""
    rnd = random.Random(5)
    more = []
    for i in range(300):
        start = at(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 40_000))
        for k in range(rnd.randint(1, 4)):
            kind = rnd.choices(["signup", "view", "click", "purchase", "other"], [3, 3, 3, 2, 1])[0]
            more.append((100_000 + 100 * i + 10 * k, start + timedelta(minutes=rnd.randint(0, 20)), 5_000 + i, kind, 1.0, "{}"))
    given = pd.read_parquet(f"{DATA}/events.parquet")
    return pd.concat([given, pd.DataFrame(more, columns=given.columns)], ignore_index=True)


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("n", [1, 4, 16])
def test_registered_time_outs_however_the_files_are_cut(spark, tmp_path, monkeypatch, n, mixed):
    rows = busy().sort_values(["ts", "event_id"])
    if mixed:
        rows = rows.sample(frac=1, random_state=n)
    for i in range(n):
        path = tmp_path / f"events{i:02}.parquet"
        part = rows.iloc[i * len(rows) // n : (i + 1) * len(rows) // n]
        part.astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + 100 * i,) * 2)
    monkeypatch.setattr(S, "read_events", functools.partial(S.read_events, bytes_per_trigger=1))
    got = callables()["stream_reap_stuck"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events*.parquet'")
    sql = oracle()["stream_reap_stuck"]
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql})").fetchall()
    assert sorted(got.columns) == sorted(COLUMNS)
    assert rows_of(got, *COLUMNS) == sorted(want, key=str)


def test_a_late_event_takes_a_time_out_back(spark, tmp_path):
    t = at(2026, 6, 1, 12)
    m = lambda k: t + timedelta(minutes=k)
    files = [
        [(i, m(0), "o", c, "retrieving") for i, c in enumerate(("ended", "earlier", "further", "same"))],
        [(10, m(60), "o", "z", "retrieving")],
        [(11, m(61), "o", "z", "complete")],
        [(12, m(5), "o", "ended", "complete"), (13, m(-5), "o", "earlier", "analyzing"), (14, m(15), "o", "further", "analyzing"), (15, m(16), "o", "same", "error")],
    ]
    for key in (("case_id", "since"), ("case_id",)):
        folder = tmp_path / str(len(key))
        got = S.run_to_table(S.reap_stuck(source(spark, folder, files), delay="2 days"), str(folder), key)
        assert rows_of(got, "case_id", "failed_stage", "since") == [("earlier", "retrieving", m(-5)), ("further", "analyzing", m(0)), ("same", "retrieving", m(0))]


@pytest.mark.parametrize("delay", ["1 minute", "2 days"])
def test_a_time_out_needs_a_newest_event_a_minute_past_the_limit(spark, tmp_path, delay):
    t = at(2026, 6, 1, 12)
    for past, out in ((timedelta(0), []), (timedelta(milliseconds=1), [("a",)])):
        folder = tmp_path / str(past.microseconds)
        files = [[(1, t, "o", "a", "retrieving")], [(2, t + timedelta(minutes=16) + past, "o", "z", "retrieving")]]
        got = S.run_to_table(S.reap_stuck(source(spark, folder, files), delay=delay), str(folder), ("case_id",))
        assert rows_of(got, "case_id") == out
