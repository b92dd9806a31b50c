"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from codevane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_equal(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    have = sorted(tuple(r[c] for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert have == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
