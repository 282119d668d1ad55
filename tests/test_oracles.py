"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(9)
        elif out[c].dtype.kind == "M":
            out[c] = out[c].astype("datetime64[us]")
    return sorted(map(tuple, out.astype(str).to_numpy()))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, db, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
