"""Every query for training data that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from kenmark.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(tables):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM read_parquet('{tables}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, tables, duck, name):
    df = queries()[name](spark, tables)
    found = duck.sql(oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    expected = sorted(tuple(str(dict(zip(found.columns, r))[c]) for c in names) for r in found.fetchall())
    assert got == expected and got
