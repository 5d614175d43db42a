"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from tallyproof.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, connection, sql) is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
