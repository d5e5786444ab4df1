"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from newsmill.plans.catalog import QUERIES
from check import compare, database

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, key):
    assert key in SQL
    assert compare(spark, con, key, QUERIES[key], SQL[key], sf_dir) is None


def test_sql_for_every_query():
    assert set(QUERIES) <= set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0
