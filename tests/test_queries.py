"""Every registered query against its SQL counterpart, and the shape of its plan."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from tallyline.plans.oracle import oracle
from tallyline.plans.registry import PLANS, callables
from tests.conftest import DATA

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL = oracle()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows_as_sql(name, spark, duck):
    df = callables()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*names).collect()])
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    header = [d[0] for d in result.description]
    assert sorted(header) == names
    order = [header.index(n) for n in names]
    want = sorted([tuple(plain(r[i]) for i in order) for r in result.fetchall()])
    assert got == want


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(PLANS)


STREAMED = {n for n in PLANS if n.startswith("stream_")} | {"export_open_hits"}


@pytest.mark.parametrize("name", sorted(set(PLANS) - STREAMED))
def test_plan_has_no_cross_join_and_no_python(name, tables):
    text = PLANS[name](tables)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, (name, bad)
