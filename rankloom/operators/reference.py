"""Statistics fitted on a reference frame and mapped onto a target frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.groups import fits_one_task
from rankloom.operators.joins import lookup
from rankloom.operators.quantiles import STATE_COST, exact_quantiles
from rankloom.operators.skew import with_percent_rank


def _finite(col: str) -> Column:
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def popularity_counts(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of the reference per hotel and per destination; 0 when unseen."""
    for key, out in (("prop_id", "prop_id_count"), ("srch_destination_id", "dest_id_count")):
        table = reference.groupBy(key).agg(F.count(F.lit(1)).alias(out))
        df = lookup(df, table, [key], {out: 0})
    return df


def own_counts(df: DataFrame) -> DataFrame:
    """Popularity counts taken from the frame itself."""
    return popularity_counts(df, df)


def score2_rank_in_destination(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Percent rank of a hotel's mean second location score among its destination's hotels."""
    score = "prop_location_score2"
    means = (
        reference.where(F.col(score).isNotNull())
        .groupBy("srch_destination_id", "prop_id")
        .agg(F.round(F.avg(score), 9).alias("_mean"))  # summation order must not split ties
    )
    ranked = with_percent_rank(means, {"score2_rank_in_dest": "_mean"}, keys=("srch_destination_id",))
    keys = ["srch_destination_id", "prop_id"]
    return lookup(df, ranked.drop("_mean"), keys, {"score2_rank_in_dest": 0.5})


def price_tier(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Price level of (destination, star) tiers with whole-table fallbacks."""
    keys = ["srch_destination_id", "prop_starrating"]
    prices = reference.select(*keys, _finite("price_usd").alias("_price"))
    overall = prices.agg(
        F.struct(F.avg("_price").alias("mean"), F.stddev_samp("_price").alias("std"))
    ).scalar()
    small = fits_one_task(prices, STATE_COST)
    overall_median = exact_quantiles(prices, [], "_price", {"m": 0.5}, small).scalar()
    tiers = prices.groupBy(*keys).agg(
        F.avg("_price").alias("price_tier_mean"),
        F.nullif(F.stddev_samp("_price"), F.lit(0.0)).alias("price_tier_std"),
        F.count("_price").alias("price_tier_count"),
    )
    medians = exact_quantiles(prices, keys, "_price", {"price_tier_median": 0.5}, small)
    out = lookup(df, tiers.join(medians, keys, "left"), keys, {"price_tier_count": 0})
    spread = overall["std"]
    safe_spread = F.when(spread > 1e-6, spread).otherwise(F.lit(1.0))
    out = out.withColumns({
        "price_tier_mean": F.coalesce("price_tier_mean", overall["mean"]),
        "price_tier_median": F.coalesce("price_tier_median", overall_median),
        "price_tier_std": F.coalesce("price_tier_std", safe_spread),
    })
    return out.withColumns({
        "price_z_in_tier": (F.col("price_usd") - F.col("price_tier_mean")) / F.col("price_tier_std"),
        "price_vs_tier_median": F.col("price_usd") / F.greatest("price_tier_median", F.lit(1.0)),
    })


def hotel_price_stats(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean and spread of a hotel's price in the reference, and the row's deviation."""
    price = _finite("price_usd")
    table = reference.groupBy("prop_id").agg(
        F.avg(price).alias("prop_id_price_mean"), F.stddev_samp(price).alias("prop_id_price_std")
    )
    overall = reference.agg(F.avg(price)).scalar()
    out = lookup(df, table, ["prop_id"], {"prop_id_price_mean": overall, "prop_id_price_std": 0.0})
    return out.withColumn("price_dev_from_prop_mean", F.col("price_usd") - F.col("prop_id_price_mean"))


def impute_score2(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Null second location scores become the first quartile of the hotel's country."""
    score = "prop_location_score2"
    small = fits_one_task(reference, STATE_COST)
    quartile = exact_quantiles(reference, ["prop_country_id"], score, {"_q1": 0.25}, small)
    overall = exact_quantiles(reference, [], score, {"q": 0.25}, small).scalar()
    out = lookup(df, quartile, ["prop_country_id"])
    return out.withColumn(score, F.coalesce(F.col(score), F.col("_q1"), overall)).drop("_q1")


def distance_features(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance imputed by the country pair's median, then by the overall median."""
    keys = ["visitor_location_country_id", "prop_country_id"]
    distance = "orig_destination_distance"
    small = fits_one_task(reference, STATE_COST)
    pair = exact_quantiles(reference, keys, distance, {"orig_distance_country_pair_median": 0.5}, small)
    overall = exact_quantiles(reference, [], distance, {"m": 0.5}, small).scalar()
    out = lookup(df, pair, keys, {"orig_distance_country_pair_median": overall})
    out = out.withColumns({
        "orig_distance_was_missing": F.col(distance).isNull().cast("int"),
        "orig_distance_imputed": F.coalesce(distance, "orig_distance_country_pair_median"),
    })
    return out.withColumn("log_distance_imputed", F.log1p("orig_distance_imputed"))


def visitor_destination_popularity(df: DataFrame, reference: DataFrame) -> DataFrame:
    keys = ["visitor_location_country_id", "srch_destination_id"]
    table = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("visitor_dest_popularity"))
    out = lookup(df, table, keys, {"visitor_dest_popularity": 0})
    return out.withColumn("log_visitor_dest_popularity", F.log1p("visitor_dest_popularity"))


def price_convention(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Price per night against the median of the (site, hotel country) market."""
    keys = ["site_id", "prop_country_id"]
    small = fits_one_task(reference, STATE_COST)
    market = exact_quantiles(reference, keys, "price_per_night", {"market_price_per_night_median": 0.5}, small)
    overall = exact_quantiles(reference, [], "price_per_night", {"m": 0.5}, small).scalar()
    out = lookup(df, market, keys, {"market_price_per_night_median": overall})
    floor = F.greatest("market_price_per_night_median", F.lit(1.0))
    return out.withColumn("price_convention_residual", F.col("price_per_night") / floor)
