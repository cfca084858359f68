from __future__ import annotations

import duckdb
import pytest

from tallyline.llm.queries import QUERIES, SQL
from tests.llm.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    result = con.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(tuple, got.select(order).collect())) == sorted(result.fetchall())
