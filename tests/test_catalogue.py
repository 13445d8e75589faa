"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gristmill.plans import catalogue, store_queries  # noqa: F401


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    q = duck.sql(catalogue.ORACLES[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in q.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["conv_id", "instruction", "input", "output"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
