"""Every query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from classmeter.plans.catalog import QUERIES
from classmeter.plans.oracle import ORACLE as SQL
from compare import connect, differences
from conftest import SF

# With few rows per problem no one is above the ratio there.
MAY_BE_EMPTY = {"key_uniqueness"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(spark, con, key):
    found = differences(spark, con, SF, QUERIES[key], SQL[key])
    assert found is None or (found == "empty" and key in MAY_BE_EMPTY)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
