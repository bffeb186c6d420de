"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from workbench.cases import CASES
from workbench.compare import check, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(CASES))
def test_query(spark, connection, name):
    line = check(spark, connection, FOLDER, name)
    assert "FAIL" not in line, line


def test_entry(spark):
    assert driver.entry(spark).count() == 1500
    assert set(driver.oracle_sql()) <= set(driver.queries())
