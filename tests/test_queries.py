"""Every registered query beside its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = os.environ.get("GRIDSPARK_TEST_DATA", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in SQL))
def test_query_equals_sql(spark, con, name):
    state, rows, note = compare(con, spark, entry.queries()[name], SQL[name], FOLDER)
    assert state == "ok", f"{state}: {note}"


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and not n.startswith(("op", "pipeline"))))
def test_query_without_sql_returns_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "average" in df.columns
