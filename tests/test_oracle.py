"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e
from snapstrata.plans.oracle import ORACLES
from snapstrata.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df, cols):
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    assert rows(ours, cols) == rows(theirs, cols)


def test_rows_only(spark):
    assert all(r.ok for r in QUERIES["codec_roundtrip"](spark, SF).collect())
    assert {r.path for r in QUERIES["tree_scan"](spark, SF).collect()} == {"a/empty", "a/.hidden", "_x", "ab/z"}


def test_entry(spark):
    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
