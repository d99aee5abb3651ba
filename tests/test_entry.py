"""The driver's contract, and every registered query against its SQL on small data."""

import pytest

import __spark_entry__ as driver
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship_query(spark):
    df = driver.entry(spark)
    assert df.columns == ["project", "author", "effort"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_its_sql(spark, con, name):
    assert difference(spark, con, name, SF) is None
