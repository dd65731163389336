"""Every registered query with SQL agrees with DuckDB on the same tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(driver.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, driver.queries()[name], driver.oracle_sql()[name], FOLDER)
    assert problem is None, problem


def test_entry(spark):
    assert driver.entry(spark).count() > 0
