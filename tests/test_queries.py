"""Every registered query with an oracle gives the oracle's rows."""

import math

import duckdb
import pandas as pd
import pytest

from quirelight.plans import catalogue as C


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in C.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows(df):
    return sorted(tuple(map(_value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(C.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    got, want = C.QUERIES[name](spark, sf).toPandas(), con.sql(C.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(C.QUERIES) - set(C.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert C.QUERIES[name](spark, sf).count() > 0
