"""Oversized groups are few: rows are not shuffled to meet their keys or brackets."""

from pyspark.sql import functions as F

from rankloom.operators import quantiles
from rankloom.operators.groups import by_group_size


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_oversized_keys_are_looked_up(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"))
    big = df.groupBy("k").count().where("k = 1").select("k").checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = by_group_size(df, ["k"], lambda part: part, lambda part: part, big)
        brackets = quantiles._bracketed(df.withColumnRenamed("x", "_x"), ["k"], {"m": 0.5}, quantiles.MARGIN)
        assert plan(both).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan(both)
        assert "BroadcastHashJoin" in plan(brackets) and both.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
