"""Every registered query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, difference, frame

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, duck, name):
    left = frame(contract.queries()[name](spark, SF).toArrow())
    right = frame(duck.sql(contract.oracle_sql()[name]).to_arrow_table())
    assert difference(left, right) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 5
