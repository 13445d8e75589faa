"""Queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from gristmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    q = con.sql(ORACLES[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in q.fetchall())
