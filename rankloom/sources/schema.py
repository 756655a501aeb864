"""Column types of the search log."""

from __future__ import annotations

from pyspark.sql import types as T

COMPETITORS = range(1, 9)

_LONG = ("srch_id", "prop_id", "srch_destination_id")
_INT = (
    "site_id", "visitor_location_country_id", "prop_country_id", "prop_starrating",
    "prop_brand_bool", "position", "promotion_flag", "srch_length_of_stay",
    "srch_booking_window", "srch_adults_count", "srch_children_count", "srch_room_count",
    "srch_saturday_night_bool", "random_bool", "click_bool", "booking_bool",
)

# Column order of the log file (fixed by its format).
LOG_COLUMNS = [
    "srch_id", "date_time", "site_id", "visitor_location_country_id",
    "visitor_hist_starrating", "visitor_hist_adr_usd", "prop_country_id", "prop_id",
    "prop_starrating", "prop_review_score", "prop_brand_bool", "prop_location_score1",
    "prop_location_score2", "prop_log_historical_price", "position", "price_usd",
    "promotion_flag", "srch_destination_id", "srch_length_of_stay", "srch_booking_window",
    "srch_adults_count", "srch_children_count", "srch_room_count",
    "srch_saturday_night_bool", "srch_query_affinity_score", "orig_destination_distance",
    "random_bool",
    *[f"comp{i}_{part}" for i in COMPETITORS for part in ("rate", "inv", "rate_percent_diff")],
    "click_bool", "gross_bookings_usd", "booking_bool",
]
LABEL_COLUMNS = ["position", "click_bool", "gross_bookings_usd", "booking_bool"]


def _type(name: str) -> T.DataType:
    if name in _LONG:
        return T.LongType()
    if name in _INT:
        return T.IntegerType()
    return T.TimestampNTZType() if name == "date_time" else T.DoubleType()


def log_schema(labels: bool = True) -> T.StructType:
    """Schema of the training log, or of the test log when ``labels`` is false."""
    return T.StructType([
        T.StructField(name, _type(name))
        for name in LOG_COLUMNS
        if labels or name not in LABEL_COLUMNS
    ])
