"""Queries with SQL give the same rows in DuckDB; all queries are registered, one an operator."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, kinds_differ, rows_of_spark, rows_of_sql

from rankweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con, sql = connect(SF), queries.oracle_sql()[name]
    df = queries.queries()[name](spark, SF)
    assert rows_of_spark(df) == rows_of_sql(con, sql)
    assert not kinds_differ(df, con, sql)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
