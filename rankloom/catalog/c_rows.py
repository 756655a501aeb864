"""Row-wise features."""

from rankloom.catalog.base import BUCKET_SQL, query
from rankloom.functions import rows
from rankloom.operators.skew import with_percent_rank
from rankloom.sources.schema import COMPETITORS

ID = "srch_id prop_id "


def _sum(template: str) -> str:
    return " + ".join(template.format(i=i) for i in COMPETITORS)


@query(
    "C1_price_features",
    """SELECT srch_id, prop_id, price_usd / (exp(prop_log_historical_price) + 1) AS price_vs_historical,
      price_usd / (visitor_hist_adr_usd + 1) AS price_vs_visitor_hist,
      prop_starrating - visitor_hist_starrating AS star_diff_visitor,
      price_usd / ((srch_adults_count + srch_children_count) * srch_length_of_stay + 1) AS price_per_person,
      CASE WHEN price_usd / (exp(prop_log_historical_price) + 1) < 1 THEN 1 ELSE 0 END AS is_deal,
      exp(prop_log_historical_price) - price_usd AS ump,
      price_usd * srch_room_count / greatest(srch_adults_count + srch_children_count, 1) AS per_fee FROM log""",
    exact=ID + "is_deal",
    d6="price_vs_historical price_vs_visitor_hist star_diff_visitor price_per_person per_fee", d4="ump",
)
def price_features(ctx):
    return rows.price_features(ctx.log)


_NULLMAX = "list_max([" + ", ".join(f"comp{i}_rate_percent_diff" for i in COMPETITORS) + "])"
_NULLAVG = "list_avg(list_filter([" + ", ".join(f"comp{i}_rate_percent_diff" for i in COMPETITORS) + "], lambda x: x IS NOT NULL))"
_CHEAPER = _sum("CASE WHEN comp{i}_rate = 1 THEN 1 ELSE 0 END")
_PRICIER = _sum("CASE WHEN comp{i}_rate = -1 THEN 1 ELSE 0 END")
_KNOWN = _sum("CASE WHEN comp{i}_rate IS NOT NULL THEN 1 ELSE 0 END")
_SOLD_OUT = _sum("CASE WHEN comp{i}_inv = 1 THEN 1 ELSE 0 END")


@query(
    "C2_competitor_features",
    f"""SELECT srch_id, prop_id, {_CHEAPER} AS comp_cheaper_count, {_PRICIER} AS comp_pricier_count,
      {_sum("CASE WHEN comp{i}_rate = 0 THEN 1 ELSE 0 END")} AS comp_same_count,
      {_SOLD_OUT} AS comp_no_inventory_count, {_KNOWN} AS comp_data_count,
      {_NULLAVG} AS comp_avg_diff, {_NULLMAX} AS comp_max_diff,
      coalesce(CAST({_CHEAPER} AS DOUBLE) / nullif({_KNOWN}, 0), 0) AS comp_cheaper_frac FROM log""",
    exact=ID + "comp_cheaper_count comp_pricier_count comp_same_count comp_no_inventory_count comp_data_count",
    d6="comp_avg_diff comp_max_diff comp_cheaper_frac",
)
def competitor_features(ctx):
    return rows.competitor_features(ctx.log)


_FLAGS = [f"{c}_missing" for c in rows.MISSING_FLAG_COLUMNS] + ["has_visitor_history"]


@query(
    "C3_missing_flags",
    "SELECT srch_id, prop_id, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in rows.MISSING_FLAG_COLUMNS)
    + ", CASE WHEN visitor_hist_starrating IS NULL THEN 0 ELSE 1 END AS has_visitor_history FROM log",
    exact=ID + " ".join(_FLAGS),
)
def missing_flags(ctx):
    return rows.missing_flags(ctx.log)


@query(
    "C4_calendar",
    """SELECT srch_id, prop_id, CAST(month(date_time) AS INTEGER) AS month,
      CAST(isodow(date_time) - 1 AS INTEGER) AS day_of_week, CAST(hour(date_time) AS INTEGER) AS hour,
      CASE WHEN isodow(date_time) >= 6 THEN 1 ELSE 0 END AS is_weekend_search FROM log""",
    exact=ID + "month day_of_week hour is_weekend_search",
)
def calendar(ctx):
    return rows.calendar_features(ctx.log)


@query(
    "C5_window_bucket", f"SELECT srch_id, prop_id, {BUCKET_SQL} AS booking_window_bucket FROM log",
    exact=ID + "booking_window_bucket",
)
def window_bucket(ctx):
    return rows.with_window_bucket(ctx.log)


@query(
    "C6_location_interactions",
    """SELECT srch_id, prop_id, coalesce(prop_location_score2, 0) * prop_location_score1 AS score2ma,
      prop_location_score1 / (coalesce(prop_location_score2, 0) + 1) AS score1d2,
      (coalesce(prop_location_score2, 0) + 0.0001e0) / (prop_location_score1 + 0.0001e0) AS score1d2_liu,
      coalesce(prop_location_score2, 0) * coalesce(srch_query_affinity_score, 0) AS score2ma_liu FROM log""",
    exact=ID, d6="score2ma score1d2 score2ma_liu", d4="score1d2_liu",
)
def location_interactions(ctx):
    return rows.location_interactions(ctx.log)


@query(
    "C7_trip_features",
    """SELECT srch_id, prop_id,
      CASE WHEN visitor_location_country_id = prop_country_id THEN 1 ELSE 0 END AS is_domestic,
      CASE WHEN srch_children_count > 0 THEN 1 ELSE 0 END AS is_family,
      greatest(srch_adults_count + srch_children_count, 1) AS total_guests,
      CAST(srch_children_count AS DOUBLE) / greatest(srch_adults_count + srch_children_count, 1) AS children_ratio,
      price_usd / greatest(srch_length_of_stay, 1) AS price_per_night,
      ln(1 + orig_destination_distance) AS log_distance,
      orig_destination_distance * price_usd AS distance_price_interaction,
      srch_booking_window * srch_saturday_night_bool AS booking_window_x_saturday,
      prop_starrating / greatest(price_usd, 1e0) AS starrating_price_ratio,
      prop_starrating * prop_brand_bool AS starrating_x_brand,
      price_usd - visitor_hist_adr_usd AS visitor_hist_price_diff,
      2 * prop_starrating + coalesce(prop_review_score, 0) + prop_location_score1 + prop_location_score2 AS prop_quality_score
      FROM log""",
    exact=ID + "is_domestic is_family total_guests booking_window_x_saturday starrating_x_brand",
    d6="children_ratio price_per_night log_distance starrating_price_ratio visitor_hist_price_diff prop_quality_score",
    d4="distance_price_interaction",
)
def trip_features(ctx):
    return rows.trip_features(ctx.log)


@query(
    "C8_competitor_advantage",
    f"""SELECT srch_id, prop_id,
      coalesce(CAST({_sum("coalesce(comp{i}_rate, 0) * coalesce(comp{i}_rate_percent_diff, 0)")} AS DOUBLE) / nullif({_KNOWN}, 0), 0) AS comp_rate_weighted_diff,
      coalesce(CAST({_CHEAPER} - ({_PRICIER}) AS DOUBLE) / nullif({_KNOWN}, 0), 0) AS comp_advantage_score,
      coalesce(CAST({_SOLD_OUT} AS DOUBLE) / nullif({_KNOWN}, 0), 0) AS comp_no_inventory_frac,
      CASE WHEN {_SOLD_OUT} > 0 THEN 1 ELSE 0 END AS any_comp_no_inventory FROM log""",
    exact=ID + "any_comp_no_inventory", d6="comp_rate_weighted_diff comp_advantage_score comp_no_inventory_frac",
)
def competitor_advantage(ctx):
    return rows.competitor_advantage(rows.competitor_features(ctx.log))


PRICE_RANK_SQL = (
    "(rank() OVER (PARTITION BY srch_id ORDER BY price_usd) + (count(*) OVER (PARTITION BY srch_id, price_usd) - 1) / 2e0)"
    " / count(price_usd) OVER (PARTITION BY srch_id)"
)


@query(
    "C9_trip_flags",
    f"""
, r AS (SELECT *, {PRICE_RANK_SQL} AS price_usd_rank,
        CASE WHEN price_usd / (exp(prop_log_historical_price) + 1) < 1 THEN 1 ELSE 0 END AS is_deal FROM log)
SELECT srch_id, prop_id, CASE WHEN srch_booking_window <= 1 THEN 1 ELSE 0 END AS is_last_minute,
      CASE WHEN srch_booking_window >= 30 THEN 1 ELSE 0 END AS is_advance_purchase,
      CASE WHEN srch_saturday_night_bool = 1 OR srch_length_of_stay >= 3 THEN 1 ELSE 0 END AS is_leisure_search,
      CASE WHEN srch_booking_window <= 1 THEN price_usd_rank ELSE 0 END AS last_minute_x_price_rank,
      srch_booking_window * is_deal AS window_x_deal FROM r""",
    exact=ID + "is_last_minute is_advance_purchase is_leisure_search window_x_deal", d6="last_minute_x_price_rank",
)
def trip_flags(ctx):
    ranked = with_percent_rank(ctx.log, {"price_usd_rank": "price_usd"}, oversized=ctx.big)
    return rows.trip_flags(rows.price_features(ranked))


@query(
    "C10_checkin_calendar",
    """SELECT srch_id, prop_id, CAST(month(CAST(date_time AS DATE) + srch_booking_window) AS INTEGER) AS checkin_month,
      CAST(isodow(CAST(date_time AS DATE) + srch_booking_window) - 1 AS INTEGER) AS checkin_dow FROM log""",
    exact=ID + "checkin_month checkin_dow",
)
def checkin(ctx):
    return rows.checkin_features(ctx.log)


@query(
    "C12_relevance", "SELECT srch_id, prop_id, rel AS relevance FROM scored", exact=ID + "relevance",
)
def relevance(ctx):
    return rows.with_relevance(ctx.log)


@query(
    "C13_narrow_types",
    """SELECT srch_id, prop_id, srch_destination_id, CAST(position AS INTEGER) AS position,
      CAST(price_usd AS REAL) AS price_usd, CAST(orig_destination_distance AS REAL) AS orig_destination_distance FROM log""",
    exact=ID + "srch_destination_id position price_usd orig_destination_distance",
)
def narrow(ctx):
    return rows.narrow_types(ctx.log.select(*(ID + "srch_destination_id position price_usd orig_destination_distance").split()))


@query(
    "C14_feature_columns",
    "SELECT prop_id, site_id, visitor_location_country_id, prop_starrating, price_usd, srch_destination_id FROM log",
    exact="prop_id site_id visitor_location_country_id prop_starrating srch_destination_id", d6="price_usd",
)
def feature_columns(ctx):
    return ctx.log.select(*rows.feature_columns(ctx.log.columns))


@query(
    "C16_finite_or_null",
    """SELECT srch_id, prop_id, CASE WHEN click_bool = 0 THEN NULL ELSE price_usd / click_bool END AS price_per_click FROM log""",
    exact=ID, d6="price_per_click",
)
def finite(ctx):
    from pyspark.sql import functions as F

    clicks = F.col("click_bool").cast("double")
    per_click = F.when(clicks == 0, F.lit(float("inf"))).otherwise(F.col("price_usd") / F.nullif(clicks, F.lit(0.0)))
    return rows.finite_or_null(ctx.log.withColumn("price_per_click", per_click), ["price_per_click"])
