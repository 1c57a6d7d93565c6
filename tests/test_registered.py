"""Every registered query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import os

import pytest
from compare import connect, kinds_differ, rows_of_spark, rows_of_sql

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {name: sql for name, (_, sql) in entry_module.REGISTERED.items() if sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    names, got = rows_of_spark(df)
    columns, want = rows_of_sql(con, SQL[name])
    assert names == columns
    assert not kinds_differ(df, con, SQL[name])
    assert sum(got.values()) > 0
    assert not got - want and not want - got, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(entry_module.REGISTERED) - set(SQL)))
def test_runs(spark, name):
    assert entry_module.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
