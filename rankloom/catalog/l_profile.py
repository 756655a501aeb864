"""Profiling and bias tables."""

from __future__ import annotations

from rankloom.catalog.base import BUCKET_SQL, hash_sql, query
from rankloom.catalog.k_metrics import pair_sql
from rankloom.functions.rows import RATES
from rankloom.functions.snap import snap_sql
from rankloom.operators import profile
from rankloom.sources.schema import LOG_COLUMNS

ID = "srch_id prop_id "
RATE_SQL = "avg(CAST(booking_bool AS DOUBLE)) AS booking_rate, avg(CAST(click_bool AS DOUBLE)) AS click_rate, count(*) AS n_rows"


@query(
    "L1_log_overview",
    f"""SELECT count(*) AS n_rows, count(DISTINCT srch_id) AS n_searches, count(DISTINCT prop_id) AS n_hotels,
      count(DISTINCT srch_destination_id) AS n_destinations, {len(LOG_COLUMNS)} AS n_columns FROM log""",
    exact="n_rows n_searches n_hotels n_destinations n_columns",
)
def overview(ctx):
    return profile.log_overview(ctx.log)


@query("L2_group_size_histogram",
       "SELECT least(n, 50) AS group_size, count(*) AS n_searches FROM (SELECT count(*) AS n FROM log GROUP BY srch_id) GROUP BY 1",
       exact="group_size n_searches")
def group_sizes(ctx):
    return profile.group_size_histogram(ctx.log)


def describe_sql(columns, relation: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,"
        f" CAST(max({c}) AS DOUBLE) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,"
        f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM {relation}"
        for c in columns
    )


@query("L2_group_size_summary",
       f"\n, z AS (SELECT count(*) AS group_size FROM log GROUP BY srch_id), d AS ({describe_sql(['group_size'], 'z')})\nSELECT * FROM d",
       exact="name count", d6="mean std min max q25 q50 q75")
def group_summary(ctx):
    return profile.group_size_summary(ctx.log)


@query(
    "L3_label_rates",
    """SELECT avg(CAST(click_bool AS DOUBLE)) AS click_rate, avg(CAST(booking_bool AS DOUBLE)) AS booking_rate,
      CAST(sum(booking_bool) AS DOUBLE) / sum(click_bool) AS book_given_click,
      count(*) FILTER (WHERE booking_bool = 1 AND click_bool = 0) AS bookings_without_click FROM log""",
    exact="bookings_without_click", d6="click_rate booking_rate book_given_click",
)
def label_rates(ctx):
    return profile.label_rates(ctx.log)


@query(
    "L4_label_crosstab",
    """SELECT CASE WHEN grouping(click_bool) = 1 THEN 'All' ELSE CAST(click_bool AS VARCHAR) END AS click,
      CASE WHEN grouping(booking_bool) = 1 THEN 'All' ELSE CAST(booking_bool AS VARCHAR) END AS booking, count(*) AS n_rows
      FROM log GROUP BY CUBE (click_bool, booking_bool)""",
    exact="click booking n_rows",
)
def crosstab(ctx):
    return profile.label_crosstab(ctx.log)


_PER_SEARCH = "s AS (SELECT srch_id, CAST(sum(click_bool) AS BIGINT) AS c, CAST(sum(booking_bool) AS BIGINT) AS b FROM log GROUP BY 1)"


@query(
    "L5_label_counts_per_search",
    f"""
, {_PER_SEARCH}, u AS (SELECT 'clicks' AS label, least(c, 10) AS per_search FROM s UNION ALL SELECT 'bookings', least(b, 5) FROM s)
SELECT label, per_search, count(*) AS n_searches FROM u GROUP BY 1, 2""",
    exact="label per_search n_searches",
)
def label_counts(ctx):
    return profile.label_counts_per_search(ctx.log)


@query(
    "L5_empty_search_share",
    f"""
, {_PER_SEARCH}
SELECT avg(CASE WHEN c = 0 THEN 1e0 ELSE 0 END) AS share_without_click, avg(CASE WHEN b = 0 THEN 1e0 ELSE 0 END) AS share_without_booking FROM s""",
    d6="share_without_click share_without_booking",
)
def empty_share(ctx):
    return profile.empty_search_share(ctx.log)


_HIST = ["price_usd", "prop_log_historical_price", "visitor_hist_adr_usd", "visitor_hist_starrating"]


def _hist_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS name, CAST(least(coalesce(floor((least({c}, hi) - lo) / nullif(hi - lo, 0) * 80), 0), 79) AS BIGINT) AS bin, count(*) AS n_rows"
        f" FROM log CROSS JOIN (SELECT quantile_cont({c}, 0.99) AS hi, min({c}) AS lo FROM log) WHERE {c} IS NOT NULL GROUP BY 1, 2"
    )


@query("L6_clipped_histogram", "\n, h AS (" + " UNION ALL ".join(_hist_sql(c) for c in _HIST) + ")\nSELECT * FROM h", exact="name bin n_rows")
def histogram(ctx):
    return profile.clipped_histogram(ctx.log, _HIST)


@query(
    "L7_null_and_zero_share",
    "\n, h AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END) AS null_share, avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0 END) AS zero_share FROM log"
        for c in ("prop_review_score", "prop_location_score2", "srch_query_affinity_score", "prop_starrating")
    ) + ")\nSELECT * FROM h",
    exact="name", d6="null_share zero_share",
)
def shares(ctx):
    return profile.null_and_zero_share(ctx.log, ["prop_review_score", "prop_location_score2", "srch_query_affinity_score", "prop_starrating"])


@query("L8_value_counts", "SELECT prop_starrating AS value, count(*) AS n_rows FROM log GROUP BY 1", exact="value n_rows")
def value_counts(ctx):
    return profile.value_counts(ctx.log, "prop_starrating")


@query("L8_top10_destinations",
       "SELECT srch_destination_id AS value, count(*) AS n_rows FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", exact="value n_rows")
def top_destinations(ctx):
    return profile.value_counts(ctx.log, "srch_destination_id", 10)


@query(
    "L9_booked_prices",
    """
, b AS (SELECT * FROM log WHERE booking_bool = 1 AND price_usd IS NOT NULL AND gross_bookings_usd IS NOT NULL)
SELECT srch_id, prop_id, price_usd, gross_bookings_usd, (SELECT quantile_cont(price_usd, 0.99) FROM b) AS price_cut,
      (SELECT quantile_cont(gross_bookings_usd, 0.99) FROM b) AS gross_cut FROM b""",
    exact=ID, d4="price_usd gross_bookings_usd price_cut gross_cut",
)
def booked_prices(ctx):
    return profile.booked_prices(ctx.log)


@query("L10_rates_by_category", f"SELECT prop_starrating, promotion_flag, {RATE_SQL} FROM log GROUP BY 1, 2",
       exact="prop_starrating promotion_flag n_rows", d6="booking_rate click_rate")
def rates_by_category(ctx):
    return profile.rates_by(ctx.log, "prop_starrating", "promotion_flag")


@query("L11_supported_rates", f"SELECT prop_id, {RATE_SQL} FROM log GROUP BY 1 HAVING count(*) >= 30",
       exact="prop_id n_rows", d6="booking_rate click_rate")
def supported(ctx):
    return profile.supported_rates(ctx.log, "prop_id", 30)


@query(
    "L12_window_rates",
    f"SELECT ['0', '1', '2-7', '8-14', '15-30', '31-90', '91-365', '365+'][CAST({BUCKET_SQL} AS INTEGER) + 1] AS \"window\", {RATE_SQL} FROM log WHERE {BUCKET_SQL} IS NOT NULL GROUP BY 1",
    exact="window n_rows", d6="booking_rate click_rate",
)
def window_rates(ctx):
    return profile.window_rates(ctx.log)


def _bin_sql(c: str) -> str:
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    return (
        f"SELECT '{c}' AS name, CAST(len(list_filter(e[2:len(e)-1], lambda v: v < CAST({c} AS DOUBLE))) AS INTEGER) AS bin, avg(CAST(booking_bool AS DOUBLE)) AS booking_rate, count(*) AS n_rows"
        f" FROM log CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) AS e FROM log) WHERE {c} IS NOT NULL GROUP BY 1, 2"
    )


@query("L13_quantile_bin_rates", "\n, h AS (" + " UNION ALL ".join(_bin_sql(c) for c in profile.QUANTILE_BIN_COLUMNS) + ")\nSELECT * FROM h",
       exact="name bin n_rows", d6="booking_rate")
def quantile_bins(ctx):
    return profile.quantile_bin_rates(ctx.log)


_EXCLUDED = {"srch_id", "prop_id", "srch_destination_id", "site_id", "prop_country_id", "visitor_location_country_id", "date_time"}
_NUMERIC = [c for c in LOG_COLUMNS if c not in _EXCLUDED and c not in ("click_bool", "booking_bool")]


def _correlates_sql(label: str, key: str, limit: str = "LIMIT 15") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{label}' AS label, corr({c}, {label}) AS r FROM log" for c in _NUMERIC)
    return f"\n, h AS ({parts})\nSELECT * FROM h WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY {snap_sql(key)} DESC, \"column\" {limit}"


@query("L14_top_correlates", _correlates_sql("booking_bool", "r"), exact="column label", d6="r")
def correlates(ctx):
    return profile.label_correlates(ctx.log, _NUMERIC, "booking_bool")


@query("L14_top_absolute_correlates", _correlates_sql("click_bool", "abs(r)"), exact="column label", d6="r")
def absolute_correlates(ctx):
    return profile.label_correlates(ctx.log, _NUMERIC, "click_bool", absolute=True)


_MATRIX = ["price_usd", "prop_location_score1", "prop_location_score2", "prop_review_score", "prop_starrating", "position", "click_bool", "booking_bool"]


@query("L14_booking_absolute_correlates", _correlates_sql("booking_bool", "abs(r)"), exact="column label", d6="r")
def booking_absolute_correlates(ctx):
    return profile.label_correlates(ctx.log, _NUMERIC, "booking_bool", absolute=True)


@query("L14_all_correlates", _correlates_sql("click_bool", "abs(r)", ""), exact="column label", d6="r")
def all_correlates(ctx):
    return profile.label_correlates(ctx.log, _NUMERIC, "click_bool", top=None, absolute=True)


@query("L14_pearson_matrix", f"\n, p AS ({pair_sql(_MATRIX, 'log')})\nSELECT * FROM p", exact="column_a column_b", d6="r")
def pearson(ctx):
    return profile.correlation_matrix(ctx.log, _MATRIX)


def _nulls_sql(columns, extra: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, 1e2 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_pct FROM log"
        for c in columns
    )
    return f"\n, h AS ({parts})\nSELECT * FROM h {extra}"


@query("L15_null_percentages", _nulls_sql(LOG_COLUMNS, "WHERE n_null > 0"), exact="column n_null", d6="null_pct")
def null_percentages(ctx):
    return profile.null_percentages(ctx.log)


@query("L16_competitor_sparsity", _nulls_sql(RATES), exact="column n_null", d6="null_pct")
def sparsity(ctx):
    return profile.competitor_sparsity(ctx.log)


_PATTERN = ["visitor_hist_starrating", "prop_review_score", "prop_location_score2", "srch_query_affinity_score", "orig_destination_distance", "comp1_rate", "gross_bookings_usd"]


@query(
    "L17_missing_pattern",
    "\n, s AS (SELECT * FROM log ORDER BY " + hash_sql("42", "srch_id", "prop_id") + ", srch_id, prop_id LIMIT 2000)\nSELECT srch_id, prop_id, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in _PATTERN) + " FROM s",
    exact=ID + " ".join(_PATTERN),
)
def missing_pattern(ctx):
    return profile.missing_pattern(ctx.log, _PATTERN)


def _effect_sql(name: str, condition: str) -> str:
    return (
        f"SELECT '{name}' AS field, avg(CAST(booking_bool AS DOUBLE)) FILTER (WHERE {condition}) AS rate_with,"
        f" avg(CAST(booking_bool AS DOUBLE)) FILTER (WHERE NOT ({condition})) AS rate_without,"
        f" avg(CAST(booking_bool AS DOUBLE)) FILTER (WHERE {condition}) / avg(CAST(booking_bool AS DOUBLE)) FILTER (WHERE NOT ({condition})) AS ratio FROM log"
    )


@query(
    "L18_missingness_effect",
    "\n, h AS (" + " UNION ALL ".join([
        _effect_sql("visitor_history", "visitor_hist_starrating IS NOT NULL"),
        _effect_sql("affinity", "srch_query_affinity_score IS NOT NULL"),
        _effect_sql("distance", "orig_destination_distance IS NOT NULL"),
        _effect_sql("any_competitor", " OR ".join(f"{c} IS NOT NULL" for c in RATES)),
    ]) + ")\nSELECT * FROM h",
    exact="field", d6="rate_with rate_without ratio",
)
def missingness_effect(ctx):
    return profile.missingness_effect(ctx.log)


@query("L19_position_rates", f"SELECT position, {RATE_SQL} FROM log GROUP BY 1", exact="position n_rows", d6="booking_rate click_rate")
def position_rates(ctx):
    return profile.position_rates(ctx.log)


@query("L20_order_rates", f"SELECT random_bool, {RATE_SQL} FROM log GROUP BY 1", exact="random_bool n_rows", d6="booking_rate click_rate")
def order_rates(ctx):
    return profile.order_rates(ctx.log)


@query(
    "L21_position_by_order",
    "SELECT position, " + ", ".join(
        f"avg(CAST({c}_bool AS DOUBLE)) FILTER (WHERE random_bool = {b}) AS {n}_{c}_rate".replace("_book_", "_booking_")
        for b, n in ((0, "normal"), (1, "random")) for c in ("booking", "click")
    ) + " FROM log GROUP BY 1",
    exact="position", d6="normal_booking_rate normal_click_rate random_booking_rate random_click_rate",
)
def position_by_order(ctx):
    return profile.position_by_order(ctx.log)


@query(
    "L21_position_bias",
    """SELECT random_bool, avg(CAST(click_bool AS DOUBLE)) FILTER (WHERE position = 1) AS first_slot_ctr, avg(CAST(click_bool AS DOUBLE)) AS overall_ctr,
      count(*) AS n_rows, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM log) AS share FROM log GROUP BY 1""",
    exact="random_bool n_rows", d6="first_slot_ctr overall_ctr share",
)
def position_bias(ctx):
    return profile.position_bias(ctx.log)


_DESCRIBED = ["price_usd", "srch_booking_window", "orig_destination_distance", "prop_review_score"]


@query("L22_describe", f"\n, d AS ({describe_sql(_DESCRIBED, 'log')})\nSELECT * FROM d", exact="name count", d4="mean std min max q25 q50 q75")
def describe(ctx):
    return profile.describe(ctx.log, _DESCRIBED)


@query("L23_top_null_features", _nulls_sql(LOG_COLUMNS, 'WHERE n_null > 0 ORDER BY n_null DESC, "column" LIMIT 25'), exact="column n_null", d6="null_pct")
def top_nulls(ctx):
    return profile.null_percentages(ctx.log, top=25)
