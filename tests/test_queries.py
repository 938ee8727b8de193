"""Registered queries against their SQL on the small tables."""

import os

import pytest

from oracle import differences, oracle_connection

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert differences(df, con, SQL[name]) == []
    spark.catalog.clearCache()


def test_flagship(spark):
    got = contract.entry(spark)
    assert {"class", "precision", "recall", "f1", "support"} == set(got.columns)
    assert got.count() > 3
