"""Every query with SQL gives what the SQL gives; every other one runs and has rows."""

import pytest

import __spark_entry__ as entry
from broadloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import connection, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


#: At this scale these are rightly empty.
MAY_BE_EMPTY = {"audit_empty_twins", "audit_zone_offsets", "same_page_hash"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    found = differences(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert found is None or found == "no rows" and name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
