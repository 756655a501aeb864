"""The staged log: dealt by search, the same rows on both routes."""

import datetime

import pandas as pd
import pytest
from conftest import SmallGroups
from pyspark.sql import functions as F

from rankloom.catalog import base
from rankloom.operators.skew import with_group_stats
from rankloom.sources.adapter import LOG_EXPRESSIONS, search_log


@pytest.fixture()
def star(tmp_path):
    """Forty orders of one to four parts, one part of an order on two lines; the first order holds fifty."""
    day = datetime.datetime(2020, 1, 1)
    lines = [(o, p % 60, p + 1) for o in range(40) for p in range(50 if o == 0 else 1 + o % 4)] + [(3, 0, 9)]
    tables = {
        "lineitem": pd.DataFrame([
            dict(l_orderkey=o, l_partkey=p, l_linenumber=n, l_quantity=2.0, l_extendedprice=100.0 + 7 * n + o, l_discount=0.02 * (n % 5),
                 l_tax=0.01 * (n % 3), l_returnflag="RAN"[(o + n) % 3]) for o, p, n in lines]),
        "orders": pd.DataFrame([
            dict(o_orderkey=o, o_custkey=o % 7, o_orderdate=day + datetime.timedelta(days=o), o_orderpriority=["1-URGENT", "5-LOW"][o % 2])
            for o in range(40)]),
        "customer": pd.DataFrame([dict(c_custkey=c, c_nationkey=c % 3, c_acctbal=100.0 * c - 50) for c in range(7)]),
        "part": pd.DataFrame([dict(p_partkey=p, p_size=p % 9, p_type=["ECONOMY", "PROMO"][p % 2], p_retailprice=900.0 + p) for p in range(60)]),
    }
    for name, table in tables.items():
        table.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_windows_by_search_need_no_shuffle(spark, star):
    log = base.Context(spark, star).log
    assert log.columns == list(LOG_EXPRESSIONS)
    counted = with_group_stats(log.select("srch_id", "price_usd"), {"n": F.count(F.lit(1))}, oversized=None)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.where("srch_id = 0").first()["n"] == 50


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_staged_rows_are_those_of_the_tables(spark, star, limit):
    """20 rows: the first search is oversized and the log is spread by range order."""
    rows = lambda df: sorted(map(str, df.collect()))
    with SmallGroups(spark, limit):
        base._staged.clear()
        ctx = base.Context(spark, star)
        assert rows(ctx.log) == rows(search_log(spark, star))
        assert (ctx.big is None) == (limit > 50)
    base._staged.clear()


def test_moved_rows_are_put_back_into_the_buckets(spark, star, monkeypatch):
    """A shuffle's own number of partitions does not grow with the rows; the log's buckets do."""
    from rankloom import session

    monkeypatch.setattr(session, "BUCKET_ROWS", 8)
    ctx = base.Context(spark, star)
    moved = ctx.by_search(ctx.log.repartition(3, "prop_id").select("srch_id", "prop_id", "price_usd"))
    counted = with_group_stats(moved, {"n": F.count(F.lit(1))}, oversized=None)
    assert ctx.buckets > 8 and counted.rdd.getNumPartitions() == ctx.buckets and counted.count() == ctx.log.count()
