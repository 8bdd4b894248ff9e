"""Registered queries against their SQL twins on the smallest data."""
import os

import pytest

import __spark_entry__ as entry
import check_queries

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, message, _ = check_queries.compare(spark, con, name, entry.queries()[name], SQL[name], SF_DIR)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 2
