"""Sampling, splits and folds."""

from pyspark.sql import functions as F

from rankloom.catalog.base import hash_sql, query
from rankloom.operators import sampling


@query(
    "B1_sample_searches",
    f"""
, ids AS (SELECT srch_id, row_number() OVER (ORDER BY {hash_sql('7', 'srch_id')}, srch_id) AS r,
        count(*) OVER () AS n FROM (SELECT DISTINCT srch_id FROM log))
SELECT l.srch_id, l.prop_id FROM log l JOIN ids USING (srch_id) WHERE r <= greatest(1, CAST(floor(n * 0.3e0) AS BIGINT))""",
    exact="srch_id prop_id",
)
def sample_searches(ctx):
    return sampling.sample_searches(ctx.log, 0.3, seed=7)


@query(
    "B2_train_validation_split",
    f"""SELECT srch_id, prop_id, CASE WHEN {hash_sql('42', 'srch_id')} % 1000000 < 200000
        THEN 'validation' ELSE 'train' END AS side FROM log""",
    exact="srch_id prop_id side",
)
def split(ctx):
    train, validation = sampling.train_validation_split(ctx.log)
    return train.withColumn("side", F.lit("train")).unionByName(validation.withColumn("side", F.lit("validation")))


@query("B3_group_folds", "SELECT srch_id, prop_id, fold FROM scored", exact="srch_id prop_id fold")
def folds(ctx):
    return sampling.with_folds(ctx.log, 5)


@query(
    "B4_negative_dropout",
    f"""
, u AS (SELECT *, (rel > 0 OR ({hash_sql('42', 'srch_id', 'prop_id')} + 0.5e0) / 4294967296e0 >= 0.35e0) AS keep FROM scored),
  w AS (SELECT *, bool_or(keep) OVER (PARTITION BY srch_id) AS any_kept,
        row_number() OVER (PARTITION BY srch_id ORDER BY prop_id) AS rn FROM u)
SELECT srch_id, prop_id, booking_bool, click_bool FROM w WHERE keep OR (NOT any_kept AND rn = 1)""",
    exact="srch_id prop_id booking_bool click_bool",
)
def negative_dropout(ctx):
    return sampling.drop_negatives(ctx.log, 0.35, 42)


@query(
    "B6_uniform_rows",
    f"SELECT srch_id, prop_id FROM log ORDER BY {hash_sql('42', 'srch_id', 'prop_id')}, srch_id, prop_id LIMIT 2000",
    exact="srch_id prop_id",
)
def uniform_rows(ctx):
    return sampling.uniform_rows(ctx.log, 2000)
