"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare
from faultline.catalog import ORACLE, QUERIES
from faultline.catalog.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


# the whole run has tests of its own
@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"full_run", "full_run_again"}))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    # what is registered beside them may lack SQL, but never has SQL without a query
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).where("status = 'Pass'").count() > 0
