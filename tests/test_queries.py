"""Every registered query with oracle SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(v):
    if v is None or v is pd.NA:
        return "null"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, bytearray)):
        return str([text(x) for x in v])
    if v != v:
        return "null"
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) and float(v).is_integer():
        return str(int(v))
    return str(v)


def rows(df):
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas() is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
