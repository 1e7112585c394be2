"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, connect
from signalvault.workload import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    sql = entry_points.oracle_sql().get(name)
    assert sql is not None
    assert compare(got, duck.sql(sql).df()) is None


def test_entry(spark):
    first = entry_points.entry(spark)
    assert first.count() > 0 and first.schema == entry_points.entry(spark).schema
