"""Queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from pixelloom.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = c.execute(queries.oracle_sql()[name])
    there = [d[0] for d in got.description]
    assert sorted(there) == columns
    order = [there.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in got.fetchall())
