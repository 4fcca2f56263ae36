"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA), duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == theirs


def test_names_are_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
