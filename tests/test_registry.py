"""Every registered query beside its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    problem, _ = compare(spark, db, QUERIES[name], SQL.get(name), FOLDER)
    assert problem in (None, "no rows")


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["event_id", "user_id", "ts", "value", "index_parent"]
