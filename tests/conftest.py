from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyline.functions.period import Period
from tallyline.session import local_session
from tallyline.sources.derived import Tables
from tallyline.sources.tables import schema
from tallyline.streaming.lifecycle import ROCKSDB

DATA = os.environ.get("TALLYLINE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def shared_root(tmp_path_factory):
    """Stands for the folder a cluster names in spark.checkpoint.dir."""
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_root):
    session = local_session(
        8, 4, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.checkpoint.dir": shared_root}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, DATA)


@pytest.fixture
def june():
    return Period(date(2026, 6, 1), date(2026, 6, 30))


@pytest.fixture(scope="session")
def make(spark):
    """Build a table of a declared layout from partial rows; absent columns are null."""

    def build(name: str, rows: list[dict], extra: tuple[str, ...] = ()):
        s = schema(name)
        full = [{f.name: r.get(f.name) for f in s.fields} for r in rows]
        return spark.createDataFrame(full, s)

    return build


@pytest.fixture(scope="session")
def frame(spark):
    """Build a frame from a DDL and row tuples."""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


def rows_of(df, *columns):
    cols = columns or df.columns
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def one(df) -> dict:
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


def at(*parts: int) -> datetime:
    return datetime(*parts)


__all__ = ["F", "at", "one", "rows_of"]
