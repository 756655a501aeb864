from pyspark.sql import functions as F

from rankloom.operators import joins


def test_a_small_fitted_table_leaves_the_log_in_place(spark, log, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        table = log.groupBy("prop_country_id").agg(F.count("*").alias("n"))
        small = joins.lookup(log, table, ["prop_country_id"], {"n": 0}, check=True)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        rows = sorted(map(tuple, small.select("srch_id", "prop_id", "n").collect()))
        monkeypatch.setattr(joins, "LOOKUP_ROWS", 1)
        large = joins.lookup(log, table, ["prop_country_id"], {"n": 0})
        assert "hashpartitioning(prop_country_id" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, large.select("srch_id", "prop_id", "n").collect())) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
