"""Group-relative features."""

from rankloom.catalog.base import query
from rankloom.functions import rows
from rankloom.operators import relative

ID = "srch_id prop_id "


def pct(col: str, part: str = "srch_id") -> str:
    """Average-tie percent rank by counting ties (not the running-count form used in Spark)."""
    return (
        f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {col} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2e0) / count({col}) OVER (PARTITION BY {part}) END"
    )


def _block(c: str) -> str:
    w = "OVER (PARTITION BY srch_id)"
    return (
        f"{pct(c)} AS {c}_rank, {c} - avg({c}) {w} AS {c}_diff_mean, {c} - median({c}) {w} AS {c}_diff_median,"
        f" min({c}) {w} AS {c}_min, max({c}) {w} AS {c}_max, stddev_samp({c}) {w} AS {c}_std"
    )


_FOUR = [c for c in relative.RELATIVE_COLUMNS if c != "price_usd"]
_PARTS = ("rank", "diff_mean", "diff_median", "min", "max", "std")


@query(
    "D1_percent_rank",
    f"SELECT srch_id, prop_id, {pct('prop_review_score')} AS review_rank, {pct('orig_destination_distance')} AS distance_rank FROM log",
    exact=ID, d6="review_rank distance_rank",
)
def percent_rank(ctx):
    from rankloom.operators.skew import with_percent_rank

    return with_percent_rank(
        ctx.log, {"review_rank": "prop_review_score", "distance_rank": "orig_destination_distance"}, oversized=ctx.big
    )


@query(
    "D2_relative_block",
    f"SELECT srch_id, prop_id, {', '.join(_block(c) for c in relative.RELATIVE_COLUMNS)} FROM log",
    exact=ID,
    d6="price_usd_rank " + " ".join(f"{c}_{p}" for c in _FOUR for p in _PARTS),
    d4=" ".join(f"price_usd_{p}" for p in _PARTS if p != "rank"),
)
def relative_block(ctx):
    return relative.relative_block(ctx.log, oversized=ctx.big)


@query(
    "D3_search_size_flags",
    """SELECT srch_id, prop_id, CAST(count(prop_id) OVER (PARTITION BY srch_id) AS INTEGER) AS search_hotel_count,
      CASE WHEN price_usd = min(price_usd) OVER (PARTITION BY srch_id) THEN 1 ELSE 0 END AS price_is_cheapest,
      CASE WHEN price_usd = max(price_usd) OVER (PARTITION BY srch_id) THEN 1 ELSE 0 END AS price_is_most_expensive
      FROM log""",
    exact=ID + "search_hotel_count price_is_cheapest price_is_most_expensive",
)
def search_size_flags(ctx):
    return relative.search_size_flags(ctx.log, oversized=ctx.big)


IMPUTED_CTE = """
, q AS (SELECT prop_country_id AS qc, quantile_cont(prop_location_score2, 0.25) AS q1 FROM log GROUP BY 1),
  imputed AS (SELECT l.* REPLACE (coalesce(prop_location_score2, q1, (SELECT quantile_cont(prop_location_score2, 0.25) FROM log)) AS prop_location_score2)
      FROM scored l LEFT JOIN q ON prop_country_id = qc)"""


@query(
    "D4_imputed_score2_block",
    IMPUTED_CTE + f"""
SELECT srch_id, prop_id, {pct('prop_location_score2')} AS prop_location_score2_imp_rank,
      prop_location_score2 - avg(prop_location_score2) OVER (PARTITION BY srch_id) AS prop_location_score2_imp_diff_mean,
      prop_location_score2 - median(prop_location_score2) OVER (PARTITION BY srch_id) AS prop_location_score2_imp_diff_median
      FROM imputed""",
    exact=ID,
    d6="prop_location_score2_imp_rank prop_location_score2_imp_diff_mean prop_location_score2_imp_diff_median",
)
def imputed_block(ctx):
    from rankloom.operators.reference import impute_score2

    return relative.imputed_score2_block(impute_score2(ctx.log, ctx.log), oversized=ctx.big)


@query(
    "D5_search_context",
    """
, w AS (SELECT *, avg(price_usd) OVER p AS m, coalesce(stddev_samp(price_usd) OVER p, 0) AS s,
      avg(prop_brand_bool) OVER p AS search_brand_frac, avg(prop_starrating) OVER p AS search_mean_star,
      avg(promotion_flag) OVER p AS search_promo_frac FROM log WINDOW p AS (PARTITION BY srch_id))
SELECT srch_id, prop_id, m AS search_price_mean, s AS search_price_std, s / (abs(m) + 1) AS search_price_cv,
      (price_usd - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS price_z_in_search, search_brand_frac, search_mean_star,
      prop_starrating - search_mean_star AS star_diff_from_search_mean, search_promo_frac FROM w""",
    exact=ID,
    d6="search_price_cv price_z_in_search search_brand_frac search_mean_star star_diff_from_search_mean search_promo_frac",
    d4="search_price_mean search_price_std",
)
def search_context(ctx):
    return relative.search_context(ctx.log, oversized=ctx.big)


@query(
    "D6_star_price_rank",
    f"SELECT srch_id, prop_id, {pct('price_usd', 'srch_id, prop_starrating')} AS price_rank_per_star FROM log",
    exact=ID, d6="price_rank_per_star",
)
def star_price_rank(ctx):
    return relative.star_price_rank(ctx.log, oversized=ctx.big)


_KNOWN = " + ".join(f"CASE WHEN comp{i}_rate IS NOT NULL THEN 1 ELSE 0 END" for i in range(1, 9))
_NET = " + ".join(f"CASE WHEN comp{i}_rate = 1 THEN 1 WHEN comp{i}_rate = -1 THEN -1 ELSE 0 END" for i in range(1, 9))
_DIRECT = f"""
, d AS (SELECT *, price_usd - visitor_hist_adr_usd AS visitor_hist_price_diff,
      2 * prop_starrating + coalesce(prop_review_score, 0) + prop_location_score1 + prop_location_score2 AS prop_quality_score,
      price_usd / greatest(srch_length_of_stay, 1) AS price_per_night,
      coalesce(CAST({_NET} AS DOUBLE) / nullif({_KNOWN}, 0), 0) AS comp_advantage_score FROM scored)"""


def _direct(ctx):
    return rows.competitor_advantage(rows.competitor_features(rows.trip_features(ctx.log)))


@query(
    "D7_direct_ranks",
    _DIRECT + "\nSELECT srch_id, prop_id, "
    + ", ".join(f"{pct(c)} AS {o}" for o, c in relative.DIRECT_RANKS.items()) + " FROM d",
    exact=ID, d6=" ".join(relative.DIRECT_RANKS),
)
def direct_ranks(ctx):
    return relative.direct_ranks(_direct(ctx), oversized=ctx.big)


_RATES = """
, g AS (SELECT avg(CAST(click_bool AS DOUBLE)) AS gc FROM log WHERE random_bool = 1),
  h AS (SELECT prop_id AS hp, sum(click_bool) AS c, count(*) AS n FROM log WHERE random_bool = 1 GROUP BY 1),
  d AS (SELECT l.*, (coalesce(c, 0) + 30 * gc) / (coalesce(n, 0) + 30) AS hotel_ctr_unbiased,
      2 * prop_starrating + coalesce(prop_review_score, 0) + prop_location_score1 + prop_location_score2 AS prop_quality_score,
      price_usd / greatest(srch_length_of_stay, 1) AS price_per_night
      FROM log l LEFT JOIN h ON prop_id = hp CROSS JOIN g)"""


def _dominance_sql(c: str, sign: str = "") -> str:
    order = "DESC" if not sign else "ASC"
    gap = f"max({c}) OVER p - {c}" if not sign else f"{c} - min({c}) OVER p"
    first = f"row_number() OVER (PARTITION BY srch_id ORDER BY {c} {order} NULLS LAST, prop_id)"
    return f"{gap} AS {c}_gap_best, CASE WHEN {c} IS NOT NULL AND {first} = 1 THEN 1 ELSE 0 END AS {c}_is_top1"


@query(
    "D8_dominance",
    _RATES + f"""
SELECT srch_id, prop_id, {_dominance_sql('prop_location_score2')}, {_dominance_sql('prop_quality_score')},
      {_dominance_sql('hotel_ctr_unbiased')}, {_dominance_sql('price_per_night', '-')}
      FROM d WINDOW p AS (PARTITION BY srch_id)""",
    exact=ID + "prop_location_score2_is_top1 prop_quality_score_is_top1 hotel_ctr_unbiased_is_top1 price_per_night_is_top1",
    d6="prop_location_score2_gap_best prop_quality_score_gap_best hotel_ctr_unbiased_gap_best", d4="price_per_night_gap_best",
)
def dominance(ctx):
    from rankloom.operators.priors import HOTEL_RATES, smoothed_priors

    frame = ctx.by_search(smoothed_priors(rows.trip_features(ctx.log), ctx.log, [HOTEL_RATES]))
    return relative.dominance(frame, oversized=ctx.big)


_TARGETS = ["hotel_ctr_unbiased", "hotel_book_rate_unbiased", "dest_hotel_affinity"]


@query(
    "D9_target_ranks",
    """
, g AS (SELECT avg(CAST(click_bool AS DOUBLE)) AS gc, avg(CAST(booking_bool AS DOUBLE)) AS gb FROM log WHERE random_bool = 1),
  h AS (SELECT prop_id AS hp, sum(click_bool) AS c, sum(booking_bool) AS b, count(*) AS n FROM log WHERE random_bool = 1 GROUP BY 1),
  dh AS (SELECT prop_id AS dp, srch_destination_id AS dd, sum(booking_bool) AS b2, count(*) AS n2 FROM log WHERE random_bool = 1 GROUP BY 1, 2),
  d AS (SELECT l.srch_id, l.prop_id, (coalesce(c, 0) + 30 * gc) / (coalesce(n, 0) + 30) AS hotel_ctr_unbiased,
      (coalesce(b, 0) + 30 * gb) / (coalesce(n, 0) + 30) AS hotel_book_rate_unbiased,
      (coalesce(b2, 0) + 30 * gb) / (coalesce(n2, 0) + 30) AS dest_hotel_affinity
      FROM log l LEFT JOIN h ON prop_id = hp LEFT JOIN dh ON prop_id = dp AND srch_destination_id = dd CROSS JOIN g)
SELECT srch_id, prop_id, """
    + ", ".join(f"{pct(c)} AS {c}_rank, {c} - avg({c}) OVER (PARTITION BY srch_id) AS {c}_diff_mean" for c in _TARGETS)
    + " FROM d",
    exact=ID, d6=" ".join(f"{c}_{p}" for c in _TARGETS for p in ("rank", "diff_mean")),
)
def target_ranks(ctx):
    from rankloom.operators.priors import DESTINATION_HOTEL, HOTEL_RATES, smoothed_priors

    frame = ctx.by_search(smoothed_priors(ctx.log, ctx.log, [HOTEL_RATES, DESTINATION_HOTEL]))
    return relative.target_ranks(frame, oversized=ctx.big)


@query(
    "D10_price_quality_pareto",
    """
, d AS (SELECT srch_id, prop_id, coalesce(price_usd / greatest(srch_length_of_stay, 1), 'infinity'::DOUBLE) AS p,
      coalesce(2 * prop_starrating + coalesce(prop_review_score, 0) + prop_location_score1 + prop_location_score2, '-infinity'::DOUBLE) AS q FROM log)
SELECT srch_id, prop_id, CASE WHEN EXISTS (SELECT 1 FROM d o WHERE o.srch_id = d.srch_id AND o.p <= d.p AND o.q > d.q)
      THEN 0 ELSE 1 END AS is_price_quality_pareto FROM d""",
    exact=ID + "is_price_quality_pareto",
)
def pareto(ctx):
    return relative.price_quality_pareto(rows.trip_features(ctx.log), oversized=ctx.big)


@query(
    "D11_sort_score_features",
    _DIRECT + f"""
, e AS (SELECT *, {pct('prop_quality_score')} AS qr,
      row_number() OVER (PARTITION BY srch_id ORDER BY s3 DESC NULLS LAST, prop_id) / CAST(count(*) OVER (PARTITION BY srch_id) AS DOUBLE) AS r FROM d)
SELECT srch_id, prop_id, r AS sort_emulator_rank, max(s3) OVER (PARTITION BY srch_id) - s3 AS sort_emulator_gap_best,
      r - qr AS sort_emulator_vs_quality_rank FROM e""",
    exact=ID, d6="sort_emulator_rank sort_emulator_gap_best sort_emulator_vs_quality_rank",
)
def sort_score(ctx):
    ranked = relative.direct_ranks(
        rows.competitor_advantage(rows.competitor_features(rows.trip_features(ctx.scored))), oversized=ctx.big
    )
    return relative.sort_score_features(ranked, score="s3", oversized=ctx.big)


@query(
    "D12_first_value",
    """SELECT srch_id, prop_id, first_value(is_domestic) OVER (PARTITION BY srch_id ORDER BY prop_id) AS search_is_domestic FROM scored""",
    exact=ID + "search_is_domestic",
)
def first_value(ctx):
    return relative.first_value(ctx.scored, "is_domestic", oversized=ctx.big)


@query(
    "D13_ideal_position",
    "SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC, prop_id) AS ideal_position FROM scored",
    exact=ID + "ideal_position",
)
def ideal_position(ctx):
    return relative.ideal_position(rows.with_relevance(ctx.log), oversized=ctx.big)


@query(
    "C11_rate_deviations",
    """
, g AS (SELECT avg(CAST(click_bool AS DOUBLE)) AS gc, avg(CAST(booking_bool AS DOUBLE)) AS gb FROM log WHERE random_bool = 1),
  h AS (SELECT prop_id AS hp, sum(click_bool) AS c, sum(booking_bool) AS b, count(*) AS n FROM log WHERE random_bool = 1 GROUP BY 1),
  t AS (SELECT srch_destination_id AS td, prop_starrating AS ts, sum(click_bool) AS c2, sum(booking_bool) AS b2, count(*) AS n2
      FROM log WHERE random_bool = 1 GROUP BY 1, 2),
  d AS (SELECT l.*, 2 * prop_starrating + coalesce(prop_review_score, 0) + prop_location_score1 + prop_location_score2 AS prop_quality_score,
      (coalesce(c, 0) + 30 * gc) / (coalesce(n, 0) + 30) - (coalesce(c2, 0) + 50 * gc) / (coalesce(n2, 0) + 50) AS hotel_ctr_vs_dest_avg,
      (coalesce(b, 0) + 30 * gb) / (coalesce(n, 0) + 30) - (coalesce(b2, 0) + 50 * gb) / (coalesce(n2, 0) + 50) AS hotel_book_vs_dest_avg
      FROM log l LEFT JOIN h ON prop_id = hp LEFT JOIN t ON srch_destination_id = td AND prop_starrating = ts CROSS JOIN g),
  e AS (SELECT *, """ + f"{pct('price_usd')} AS pr, {pct('prop_quality_score')} AS qr FROM d)" + """
SELECT srch_id, prop_id, hotel_ctr_vs_dest_avg, hotel_book_vs_dest_avg, qr - pr AS quality_rank_minus_price_rank,
      qr * (1 - pr) AS value_rank_product FROM e""",
    exact=ID, d6="hotel_ctr_vs_dest_avg hotel_book_vs_dest_avg quality_rank_minus_price_rank value_rank_product",
)
def rate_deviations(ctx):
    from rankloom.operators.priors import DESTINATION_STAR, HOTEL_RATES, smoothed_priors
    from rankloom.operators.skew import with_percent_rank

    frame = ctx.by_search(smoothed_priors(rows.trip_features(ctx.log), ctx.log, [HOTEL_RATES, DESTINATION_STAR]))
    ranked = with_percent_rank(
        frame, {"price_usd_rank": "price_usd", "prop_quality_score_rank": "prop_quality_score"}, oversized=ctx.big
    )
    return rows.rate_deviations(ranked)
