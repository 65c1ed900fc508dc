"""Every query with a SQL twin gives the same rows; the others give rows."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry
from lakegraph.catalog import all_queries as queries
from lakegraph.catalog import all_sql

FOLDER = "/root/testdata/sf0.001"
SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in queries() if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, queries()[name], SQL[name], FOLDER) is None


def test_every_query_has_sql():
    assert queries().keys() == SQL.keys()


def test_flagship(spark):
    df = entry(spark)
    assert df.columns == ["decade", "genreName", "count"] and df.count() > 0
