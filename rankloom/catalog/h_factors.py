"""Latent factors and collaborative filtering."""

from pyspark.sql import functions as F

from rankloom.catalog.base import query
from rankloom.operators import factors

ID = "srch_id prop_id "


@query(
    "H1_interactions",
    """SELECT srch_destination_id, prop_id, CAST(sum(5 * booking_bool + (click_bool - booking_bool)) AS DOUBLE) AS score
       FROM log WHERE random_bool = 1 GROUP BY 1, 2""",
    exact="srch_destination_id prop_id score",
)
def interactions(ctx):
    return factors.interactions(ctx.log, ["srch_destination_id"])


@query("H2_factor_energy")
def svd(ctx):
    """Squared factor length of each side: squared singular values, and the rank kept."""
    rows, items = factors.fit_destination_hotel(ctx.log, 20)
    energy = F.sum(factors.dot("factors", "factors")).alias("energy")
    side = lambda table, name: table.agg(energy, F.count(F.lit(1)).alias("n_keys")).withColumn("side", F.lit(name))
    return side(rows, "destination").unionByName(side(items, "hotel"))


@query("H3_H5_factor_features", exact=ID, d4="svd_affinity_score svd_cosine_similarity")
def factor_features(ctx):
    return factors.destination_hotel_factors(ctx.log, ctx.log, 20)


@query("H6_H7_contextual_cf", exact=ID, d4="site_prop_cf_score visitor_dest_prop_cf_score")
def contextual(ctx):
    return factors.cf_bundle(ctx.log, ctx.log)


@query("H8_contextual_cf_oof", exact=ID, d4="site_prop_cf_score visitor_dest_prop_cf_score")
def contextual_oof(ctx):
    return factors.cf_bundle(ctx.folds, ctx.folds, 5)
