"""Every registered query against its DuckDB oracle on the driver's sf0.001
tables (the driver repeats this at sf0.01)."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["supplier", "events", "orders"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(entry._report_sql()))
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(ocols)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(_norm(dict(zip(ocols, r))[c]) for c in order) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "co2_history" in df.columns
