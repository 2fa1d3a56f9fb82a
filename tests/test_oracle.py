"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from boxtrail.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, tmp_path, name):
    QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"FROM '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})")
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda r: sorted(r.fetchall(), key=repr)
    assert rows(duck.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'")) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
