"""Joins, set operations, sorts, top-k."""

from pyspark.sql import functions as F

from rankloom.catalog.base import query
from rankloom.operators import joins

ID = "srch_id prop_id "


@query(
    "E1_lookup_many_to_one",
    """SELECT l.srch_id, l.prop_id, coalesce(t.n, 0) AS country_rows FROM log l
       LEFT JOIN (SELECT prop_country_id, count(*) AS n FROM log GROUP BY 1) t USING (prop_country_id)""",
    exact=ID + "country_rows",
)
def lookup(ctx):
    table = ctx.log.groupBy("prop_country_id").agg(F.count(F.lit(1)).alias("country_rows"))
    return joins.lookup(ctx.log, table, ["prop_country_id"], {"country_rows": 0}, check=True)


@query("E2_attach_scores", "SELECT srch_id, prop_id, booking_bool, s1 FROM scored", exact=ID + "booking_bool", d6="s1")
def attach_scores(ctx):
    return joins.attach_scores(ctx.log.select("srch_id", "prop_id", "booking_bool"), ctx.scored.select("srch_id", "prop_id", "s1"))


@query(
    "E3_composite_lookup",
    """SELECT l.srch_id, l.prop_id, coalesce(t.m, -1e0) AS market_price FROM log l
       LEFT JOIN (SELECT site_id, prop_country_id, avg(price_usd) AS m FROM log WHERE random_bool = 1 GROUP BY 1, 2) t
       USING (site_id, prop_country_id)""",
    exact=ID, d4="market_price",
)
def composite_lookup(ctx):
    keys = ["site_id", "prop_country_id"]
    table = ctx.log.where(F.col("random_bool") == 1).groupBy(*keys).agg(F.avg("price_usd").alias("market_price"))
    return joins.lookup(ctx.log, table, keys, {"market_price": -1.0})


@query(
    "E4_context_key",
    """SELECT coalesce(visitor_hist_starrating, -1) AS visitor_hist_starrating, count(*) AS n_rows FROM log GROUP BY 1""",
    exact="visitor_hist_starrating n_rows",
)
def context_key(ctx):
    keyed = joins.context_key(ctx.log, ["visitor_hist_starrating"])
    return keyed.groupBy("visitor_hist_starrating").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "E5_keep_searches",
    "SELECT srch_id, prop_id FROM log WHERE srch_id IN (SELECT srch_id FROM log WHERE booking_bool = 1)", exact=ID,
)
def keep_searches(ctx):
    return joins.keep_searches(ctx.log, ctx.log.where(F.col("booking_bool") == 1))


@query(
    "E6_unseen_rate",
    """SELECT avg(CASE WHEN prop_id IN (SELECT prop_id FROM log WHERE random_bool = 1 AND promotion_flag = 1) THEN 0e0 ELSE 1e0 END) AS unseen_rate
       FROM log WHERE random_bool = 0""",
    d6="unseen_rate",
)
def unseen_rate(ctx):
    seen = ctx.log.where((F.col("random_bool") == 1) & (F.col("promotion_flag") == 1))
    return joins.unseen_rate(ctx.log.where(F.col("random_bool") == 0), seen)


@query(
    "E7_attach_labels",
    """SELECT srch_id, prop_id, click_bool, booking_bool, is_domestic, is_family FROM scored""",
    exact=ID + "click_bool booking_bool is_domestic is_family",
)
def attach_labels(ctx):
    # half of the click labels are blanked, so both sides of the coalesce are used
    partial = ctx.scored.select(
        "srch_id", "prop_id", "s1", F.when(F.col("position") == 1, F.col("click_bool")).alias("click_bool")
    )
    return joins.attach_labels(partial, ctx.log)


@query(
    "E8_count_reference",
    """SELECT prop_id, count(*) AS n_rows FROM (SELECT prop_id FROM log WHERE random_bool = 0 UNION ALL
       SELECT prop_id FROM log) GROUP BY prop_id""",
    exact="prop_id n_rows",
)
def count_reference(ctx):
    both = joins.count_reference(ctx.log.where(F.col("random_bool") == 0), ctx.log)
    return both.groupBy("prop_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("E9_model_order", "SELECT srch_id, prop_id FROM log", exact=ID)
def model_order(ctx):
    return joins.model_order(ctx.log)


@query("E9_group_sizes", "SELECT srch_id, count(*) AS group_size FROM log GROUP BY srch_id", exact="srch_id group_size")
def group_sizes(ctx):
    return joins.group_sizes(ctx.log)


@query(
    "E10_duplicate_keys",
    "SELECT srch_id, position, count(*) AS n_rows FROM log GROUP BY 1, 2 HAVING count(*) > 1",
    exact="srch_id position n_rows",
)
def duplicate_keys(ctx):
    return joins.duplicate_keys(ctx.log, ["srch_id", "position"])


@query(
    "E11_top_k_per_search",
    """SELECT srch_id, prop_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY s3 DESC NULLS LAST, prop_id) AS r FROM scored)
       WHERE r <= 5""",
    exact=ID + "rank",
)
def top_k(ctx):
    return joins.top_k(ctx.scored, "s3", 5)


@query("E12_first_row", "SELECT srch_id, min(prop_id) AS prop_id FROM log GROUP BY srch_id", exact=ID)
def first_row(ctx):
    return joins.first_row(ctx.log)


@query(
    "E12_top_n",
    "SELECT srch_id, prop_id, price_usd FROM log ORDER BY price_usd DESC NULLS LAST, srch_id, prop_id LIMIT 20",
    exact=ID, d6="price_usd",
)
def top_n(ctx):
    return joins.top_n(ctx.log.select("srch_id", "prop_id", "price_usd"), "price_usd", 20, "srch_id", "prop_id")
