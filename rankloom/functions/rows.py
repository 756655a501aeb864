"""Row-wise features: pure column arithmetic, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.sources.schema import COMPETITORS

RATES = [f"comp{i}_rate" for i in COMPETITORS]
INVENTORY = [f"comp{i}_inv" for i in COMPETITORS]
DIFFS = [f"comp{i}_rate_percent_diff" for i in COMPETITORS]

# Columns whose nulls are informative, and booking-window borders.
MISSING_FLAG_COLUMNS = [
    "visitor_hist_starrating", "visitor_hist_adr_usd", "srch_query_affinity_score",
    "orig_destination_distance", "prop_review_score", "prop_location_score2",
]
WINDOW_BORDERS = [-1, 0, 1, 7, 14, 30, 90, 365, 9999]


def _flag(condition: Column) -> Column:
    """Boolean as 0/1, null as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def _zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0.0))


def _total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns)


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def relevance(booking: str = "booking_bool", click: str = "click_bool") -> Column:
    """5 for a booking, 1 for a click only, 0 otherwise."""
    return (5 * F.col(booking) + F.greatest(F.col(click) - F.col(booking), F.lit(0))).cast("int")


def with_relevance(df: DataFrame) -> DataFrame:
    return df.withColumn("relevance", relevance())


def price_features(df: DataFrame) -> DataFrame:
    price, usual = F.col("price_usd"), F.exp("prop_log_historical_price")
    guests = F.col("srch_adults_count") + F.col("srch_children_count")
    against_usual = price / (usual + 1)
    return df.withColumns({
        "price_vs_historical": against_usual,
        "price_vs_visitor_hist": price / (F.col("visitor_hist_adr_usd") + 1),
        "star_diff_visitor": F.col("prop_starrating") - F.col("visitor_hist_starrating"),
        "price_per_person": price / (guests * F.col("srch_length_of_stay") + 1),
        "is_deal": _flag(against_usual < 1),
        "ump": usual - price,
        "per_fee": price * F.col("srch_room_count") / F.greatest(guests, F.lit(1)),
    })


def competitor_features(df: DataFrame) -> DataFrame:
    cheaper = _total(_flag(F.col(c) == 1) for c in RATES)
    known = _total(F.col(c).isNotNull().cast("int") for c in RATES)
    diff_count = _total(F.col(c).isNotNull().cast("int") for c in DIFFS)
    return df.withColumns({
        "comp_cheaper_count": cheaper,
        "comp_pricier_count": _total(_flag(F.col(c) == -1) for c in RATES),
        "comp_same_count": _total(_flag(F.col(c) == 0) for c in RATES),
        "comp_no_inventory_count": _total(_flag(F.col(c) == 1) for c in INVENTORY),
        "comp_data_count": known,
        "comp_avg_diff": _total(_zero(c) for c in DIFFS) / F.nullif(diff_count, F.lit(0)),
        "comp_max_diff": F.greatest(*DIFFS),
        "comp_cheaper_frac": _ratio_or_zero(cheaper, known),
    })


def missing_flags(df: DataFrame) -> DataFrame:
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in MISSING_FLAG_COLUMNS}
    flags["has_visitor_history"] = F.col("visitor_hist_starrating").isNotNull().cast("int")
    return df.withColumns(flags)


def window_bucket(col: str = "srch_booking_window") -> Column:
    """Ordinal bucket with right-closed borders; null outside them."""
    value, out = F.col(col), None
    for bucket, (low, high) in enumerate(zip(WINDOW_BORDERS, WINDOW_BORDERS[1:])):
        inside = (value > low) & (value <= high)
        out = F.when(inside, F.lit(float(bucket))) if out is None else out.when(inside, F.lit(float(bucket)))
    return out


def with_window_bucket(df: DataFrame) -> DataFrame:
    if "booking_window_bucket" in df.columns:
        return df
    return df.withColumn("booking_window_bucket", window_bucket())


def calendar_features(df: DataFrame) -> DataFrame:
    day = F.weekday("date_time")
    return df.withColumns({
        "month": F.month("date_time"),
        "day_of_week": day,
        "hour": F.hour("date_time"),
        "is_weekend_search": (day >= 5).cast("int"),
        "booking_window_bucket": window_bucket(),
    })


def checkin_features(df: DataFrame) -> DataFrame:
    checkin = F.date_add(F.to_date("date_time"), F.col("srch_booking_window"))
    return df.withColumns({"checkin_month": F.month(checkin), "checkin_dow": F.weekday(checkin)})


def location_interactions(df: DataFrame) -> DataFrame:
    one, two = F.col("prop_location_score1"), _zero("prop_location_score2")
    return df.withColumns({
        "score2ma": two * one,
        "score1d2": one / (two + 1),
        "score1d2_liu": (two + 0.0001) / (one + 0.0001),
        "score2ma_liu": two * _zero("srch_query_affinity_score"),
    })


def trip_features(df: DataFrame) -> DataFrame:
    """Party, stay, distance and quality features of one impression."""
    price, stars = F.col("price_usd"), F.col("prop_starrating")
    guests = F.greatest(F.col("srch_adults_count") + F.col("srch_children_count"), F.lit(1))
    distance = F.col("orig_destination_distance")
    quality = (
        2 * stars + _zero("prop_review_score") + F.col("prop_location_score1") + F.col("prop_location_score2")
    )
    return df.withColumns({
        "is_domestic": _flag(F.col("visitor_location_country_id") == F.col("prop_country_id")),
        "is_family": _flag(F.col("srch_children_count") > 0),
        "total_guests": guests,
        "children_ratio": F.col("srch_children_count") / guests,
        "price_per_night": price / F.greatest(F.col("srch_length_of_stay"), F.lit(1)),
        "log_distance": F.log1p(distance),
        "distance_price_interaction": distance * price,
        "booking_window_x_saturday": F.col("srch_booking_window") * F.col("srch_saturday_night_bool"),
        "starrating_price_ratio": stars / F.greatest(price, F.lit(1.0)),
        "starrating_x_brand": stars * F.col("prop_brand_bool"),
        "visitor_hist_price_diff": price - F.col("visitor_hist_adr_usd"),
        "prop_quality_score": quality,
    })


def competitor_advantage(df: DataFrame) -> DataFrame:
    """Needs the counts of :func:`competitor_features`."""
    known = F.col("comp_data_count")
    weighted = _total(_zero(r) * _zero(d) for r, d in zip(RATES, DIFFS))
    sold_out = F.col("comp_no_inventory_count")
    return df.withColumns({
        "comp_rate_weighted_diff": _ratio_or_zero(weighted, known),
        "comp_advantage_score": _ratio_or_zero(F.col("comp_cheaper_count") - F.col("comp_pricier_count"), known),
        "comp_no_inventory_frac": _ratio_or_zero(sold_out, known),
        "any_comp_no_inventory": (sold_out > 0).cast("int"),
    })


def trip_flags(df: DataFrame) -> DataFrame:
    """Needs ``price_usd_rank`` and ``is_deal``."""
    window = F.col("srch_booking_window")
    late = _flag(window <= 1)
    return df.withColumns({
        "is_last_minute": late,
        "is_advance_purchase": _flag(window >= 30),
        "is_leisure_search": _flag((F.col("srch_saturday_night_bool") == 1) | (F.col("srch_length_of_stay") >= 3)),
        "last_minute_x_price_rank": late * F.col("price_usd_rank"),
        "window_x_deal": window * F.col("is_deal"),
    })


def rate_deviations(df: DataFrame) -> DataFrame:
    """Hotel rates against their destination tier, and value from two ranks."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    for kind, left, right in (
        ("hotel_ctr_vs_dest_avg", "hotel_ctr_unbiased", "dest_star_ctr_unbiased"),
        ("hotel_book_vs_dest_avg", "hotel_book_rate_unbiased", "dest_star_book_rate_unbiased"),
        ("quality_rank_minus_price_rank", "prop_quality_score_rank", "price_usd_rank"),
    ):
        if {left, right} <= have:
            out[kind] = F.col(left) - F.col(right)
    if {"prop_quality_score_rank", "price_usd_rank"} <= have:
        out["value_rank_product"] = F.col("prop_quality_score_rank") * (1 - F.col("price_usd_rank"))
    return df.withColumns(out) if out else df


def finite_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite values and NaN become null."""
    def clean(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns({name: clean(name) for name in columns})


def narrow_types(df: DataFrame) -> DataFrame:
    """Doubles as float and non-id integers as int, applied once before a write."""
    keep = {"srch_id", "prop_id", "srch_destination_id"}
    def cast(name: str, kind: str) -> Column:
        if kind == "double":
            return F.col(name).cast("float").alias(name)
        if kind == "bigint" and name not in keep:
            return F.col(name).cast("int").alias(name)
        return F.col(name)
    return df.select(*[cast(name, kind) for name, kind in df.dtypes])


# --- feature lists ----------------------------------------------------------

# Columns that never enter a model.
NON_FEATURES = [
    "srch_id", "date_time", "position", "click_bool", "booking_bool",
    "gross_bookings_usd", "random_bool", "relevance", "fold",
]
REJECTED_FLAGS = ["visitor_hist_starrating_missing", "prop_review_score_missing", "has_visitor_history"]
FACTOR_PREFIXES = ("svd_dest_f", "svd_hotel_f")


def feature_columns(
    columns: Sequence[str], extra_drop: Iterable[str] = (), keep_factors: bool = True
) -> list[str]:
    """Model features: every column that is not a label, key or raw competitor field."""
    drop = {*NON_FEATURES, *REJECTED_FLAGS, *RATES, *INVENTORY, *DIFFS, *extra_drop}
    return [
        c for c in columns
        if c not in drop and (keep_factors or not c.startswith(FACTOR_PREFIXES))
    ]


def available(columns: Iterable[str], df: DataFrame) -> list[str]:
    have = set(df.columns)
    return [c for c in columns if c in have]

