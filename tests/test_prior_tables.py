"""A table of sums is computed once for the rows and the overall sums."""

from pyspark.sql import functions as F

from rankloom.operators import priors


def test_sums_are_computed_once(log):
    sums = priors.SumTable(log, ["prop_id"], {"n": F.lit(1.0), "book": F.col("booking_bool").cast("double")})
    assert "Aggregate" not in sums.table._jdf.queryExecution().optimizedPlan().toString()
    out, overall = sums.attach_overall(sums.attach(log))
    assert out.agg(F.max(overall["n"])).first()[0] == log.count()
