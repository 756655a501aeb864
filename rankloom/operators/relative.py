"""Features of a hotel relative to the other hotels of its search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.skew import (
    AUTO,
    SEARCH,
    oversized_groups,
    with_group_median,
    with_group_stats,
    with_pareto_flag,
    with_percent_rank,
    with_position,
)

RELATIVE_COLUMNS = [
    "price_usd", "prop_starrating", "prop_review_score", "prop_location_score1", "prop_location_score2",
]

# Target-derived columns that are also ranked inside a search.
TARGET_RANK_COLUMNS = [
    "hotel_ctr_unbiased", "hotel_book_rate_unbiased", "dest_hotel_affinity", "svd_affinity_score",
    "hotel_book_rate_by_dest", "hotel_book_rate_by_country", "hotel_book_rate_by_site",
    "dest_star_book_rate_unbiased", "dest_star_ctr_unbiased", "dest_star_click_only_rate_unbiased",
    "hotel_ctr_by_window_unbiased", "hotel_book_rate_by_window_unbiased",
    "hotel_click_only_rate_by_window_unbiased", "prop_id_book_rate_oof", "prop_id_click_rate_oof",
    "prop_id_click_only_rate_oof",
]


def resolve_oversized(df: DataFrame, oversized):
    """Find oversized searches once, so that chained operators share the answer."""
    return oversized_groups(df, SEARCH) if isinstance(oversized, str) else oversized


def relative_block(
    df: DataFrame, columns: Sequence[str] = RELATIVE_COLUMNS, oversized=AUTO
) -> DataFrame:
    """Rank, mean/median distance, min, max and std of each column per search."""
    big = resolve_oversized(df, oversized)
    stats = {}
    for c in columns:
        stats |= {
            f"_mean_{c}": F.avg(c), f"{c}_min": F.min(c), f"{c}_max": F.max(c), f"{c}_std": F.stddev_samp(c),
        }
    out = with_group_stats(df, stats, oversized=big)
    out = with_group_median(out, {f"_median_{c}": c for c in columns}, oversized=big)
    out = with_percent_rank(out, {f"{c}_rank": c for c in columns}, oversized=big)
    out = out.withColumns({
        **{f"{c}_diff_mean": F.col(c) - F.col(f"_mean_{c}") for c in columns},
        **{f"{c}_diff_median": F.col(c) - F.col(f"_median_{c}") for c in columns},
    })
    return out.drop(*[f"_mean_{c}" for c in columns], *[f"_median_{c}" for c in columns])


def search_size_flags(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Hotels per search and price-extreme flags; ties are all flagged."""
    price = F.col("price_usd")
    out = with_group_stats(df, {
        "search_hotel_count": F.count("prop_id"), "_low": F.min("price_usd"), "_high": F.max("price_usd"),
    }, oversized=oversized)
    equal = lambda other: F.coalesce(price == F.col(other), F.lit(False)).cast("int")
    return out.withColumns({
        "search_hotel_count": F.col("search_hotel_count").cast("int"),
        "price_is_cheapest": equal("_low"),
        "price_is_most_expensive": equal("_high"),
    }).drop("_low", "_high")


def imputed_score2_block(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Rank and distances of the imputed second location score."""
    big = resolve_oversized(df, oversized)
    c = "prop_location_score2"
    out = with_group_stats(df, {"_mean": F.avg(c)}, oversized=big)
    out = with_group_median(out, {"_median": c}, oversized=big)
    out = with_percent_rank(out, {f"{c}_imp_rank": c}, oversized=big)
    return out.withColumns({
        f"{c}_imp_diff_mean": F.col(c) - F.col("_mean"),
        f"{c}_imp_diff_median": F.col(c) - F.col("_median"),
    }).drop("_mean", "_median")


def search_context(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Price dispersion and mix of the whole search."""
    out = with_group_stats(df, {
        "search_price_mean": F.avg("price_usd"),
        "_std": F.stddev_samp("price_usd"),
        "search_brand_frac": F.avg("prop_brand_bool"),
        "search_mean_star": F.avg("prop_starrating"),
        "search_promo_frac": F.avg("promotion_flag"),
    }, oversized=oversized)
    mean, std = F.col("search_price_mean"), F.coalesce("_std", F.lit(0.0))
    divisor = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return out.withColumns({
        "search_price_std": std,
        "search_price_cv": std / (F.abs(mean) + 1),
        "price_z_in_search": (F.col("price_usd") - mean) / divisor,
        "star_diff_from_search_mean": F.col("prop_starrating") - F.col("search_mean_star"),
    }).drop("_std")


def star_price_rank(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Price rank among hotels of the same star class in the search."""
    return with_percent_rank(
        df, {"price_rank_per_star": "price_usd"}, keys=("srch_id", "prop_starrating"), oversized=oversized
    )


# Ranked direct features and their output names.
DIRECT_RANKS = {
    "visitor_hist_price_diff_rank": "visitor_hist_price_diff",
    "prop_quality_score_rank": "prop_quality_score",
    "srch_query_affinity_score_rank": "srch_query_affinity_score",
    "comp_advantage_rank": "comp_advantage_score",
}


def direct_ranks(df: DataFrame, oversized=AUTO) -> DataFrame:
    return with_percent_rank(df, DIRECT_RANKS, oversized=oversized)


def dominance(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Gap to the best value of the search, and a flag for the one best hotel.

    The best row is an aggregate ``max(struct(value, -prop_id))``, so no sort is
    needed; ties go to the lowest ``prop_id`` and a null value is never best.
    """
    axes = {
        "prop_location_score2": 1, "prop_quality_score": 1, "hotel_ctr_unbiased": 1,
        "svd_affinity_score": 1, "price_per_night": -1,
    }
    present = {c: sign for c, sign in axes.items() if c in df.columns}
    best = {
        f"_best_{c}": F.max(F.struct((sign * F.col(c)).alias("v"), (-F.col("prop_id")).alias("p")))
        for c, sign in present.items()
    }
    out = with_group_stats(df, best, oversized=oversized)
    new = {}
    for c, sign in present.items():
        value, top = sign * F.col(c), F.col(f"_best_{c}")
        new[f"{c}_gap_best"] = top["v"] - value
        first = F.col(c).isNotNull() & (top["p"] == -F.col("prop_id"))
        new[f"{c}_is_top1"] = F.coalesce(first, F.lit(False)).cast("int")
    return out.withColumns(new).drop(*best)


def target_ranks(
    df: DataFrame, columns: Iterable[str] = TARGET_RANK_COLUMNS, oversized=AUTO
) -> DataFrame:
    """Rank and mean distance of every target-derived column present."""
    big = resolve_oversized(df, oversized)
    present = [c for c in columns if c in df.columns]
    out = with_group_stats(df, {f"_mean_{c}": F.avg(c) for c in present}, oversized=big)
    out = with_percent_rank(out, {f"{c}_rank": c for c in present}, oversized=big)
    return out.withColumns({
        f"{c}_diff_mean": F.col(c) - F.col(f"_mean_{c}") for c in present
    }).drop(*[f"_mean_{c}" for c in present])


def price_quality_pareto(df: DataFrame, oversized=AUTO) -> DataFrame:
    """Flag hotels for which no cheaper hotel of the search is better."""
    if not {"price_per_night", "prop_quality_score"} <= set(df.columns):
        return df.withColumn("is_price_quality_pareto", F.lit(0))
    return with_pareto_flag(
        df, "is_price_quality_pareto", "price_per_night", "prop_quality_score", oversized=oversized
    )


def score_order(score: str):
    """Best score first; null scores last; ties by lowest ``prop_id``."""
    return [F.desc_nulls_last(score), F.col("prop_id").asc()]


def sort_score_features(
    df: DataFrame, score: str = "sort_emulator_score", prefix: str = "sort_emulator", oversized=AUTO
) -> DataFrame:
    """Rank of a predicted display order, gap to its best, difference from the quality rank."""
    big = resolve_oversized(df, oversized)
    out = with_group_stats(df, {"_top": F.max(score), "_size": F.count(F.lit(1))}, oversized=big)
    out = with_position(out, "_pos", score_order(score), oversized=big)
    rank = F.col("_pos") / F.col("_size")
    new = {f"{prefix}_rank": rank, f"{prefix}_gap_best": F.col("_top") - F.col(score)}
    if "prop_quality_score_rank" in df.columns:
        new[f"{prefix}_vs_quality_rank"] = rank - F.col("prop_quality_score_rank")
    return out.withColumns(new).drop("_top", "_size", "_pos")


def first_value(df: DataFrame, col: str, out: str | None = None, oversized=AUTO) -> DataFrame:
    """Value of the search's first hotel (lowest ``prop_id``) on every row."""
    return with_group_stats(df, {out or f"search_{col}": F.min_by(col, "prop_id")}, oversized=oversized)


def ideal_position(df: DataFrame, relevance_col: str = "relevance", oversized=AUTO) -> DataFrame:
    """Cumulative count in the search by falling relevance (1 = best)."""
    return with_position(df, "ideal_position", score_order(relevance_col), oversized=oversized)
