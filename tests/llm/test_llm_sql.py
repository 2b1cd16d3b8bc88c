"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest
from fixtures import DATA

from echotable.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA).select(want.columns)
    assert sorted(queries.queries()[name](spark, DATA).columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
