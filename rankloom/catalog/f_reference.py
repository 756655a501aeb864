"""Statistics fitted on a reference frame."""

from rankloom.catalog.base import query
from rankloom.catalog.d_windows import IMPUTED_CTE, pct
from rankloom.functions import rows
from rankloom.operators import priors, reference

ID = "srch_id prop_id "


@query(
    "F1_popularity_counts",
    """SELECT l.srch_id, l.prop_id, coalesce(p.n, 0) AS prop_id_count, coalesce(d.n, 0) AS dest_id_count FROM log l
      LEFT JOIN (SELECT prop_id, count(*) AS n FROM log GROUP BY 1) p USING (prop_id)
      LEFT JOIN (SELECT srch_destination_id, count(*) AS n FROM log GROUP BY 1) d USING (srch_destination_id)""",
    exact=ID + "prop_id_count dest_id_count",
)
def popularity(ctx):
    return reference.popularity_counts(ctx.log, ctx.log)


@query(
    "F2_own_counts",
    """SELECT srch_id, prop_id, count(*) OVER (PARTITION BY prop_id) AS prop_id_count,
      count(*) OVER (PARTITION BY srch_destination_id) AS dest_id_count FROM log""",
    exact=ID + "prop_id_count dest_id_count",
)
def own_counts(ctx):
    return reference.own_counts(ctx.log)


@query(
    "F3_score2_rank_in_dest",
    f"""
, m AS (SELECT srch_destination_id AS dd, prop_id AS dp, round(avg(prop_location_score2), 9) AS s FROM log
      WHERE prop_location_score2 IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT dd, dp, {pct('s', 'dd')} AS v FROM m)
SELECT srch_id, prop_id, coalesce(v, 0.5e0) AS score2_rank_in_dest FROM log
      LEFT JOIN r ON srch_destination_id = dd AND prop_id = dp""",
    exact=ID, d6="score2_rank_in_dest",
)
def score2_rank(ctx):
    return reference.score2_rank_in_destination(ctx.log, ctx.log)


@query(
    "F4_price_tier",
    """
, g AS (SELECT avg(price_usd) AS gm, median(price_usd) AS gmed, stddev_samp(price_usd) AS gs FROM log),
  t AS (SELECT srch_destination_id AS td, prop_starrating AS ts, avg(price_usd) AS m, median(price_usd) AS med,
      nullif(stddev_samp(price_usd), 0) AS s, count(price_usd) AS n FROM log GROUP BY 1, 2),
  d AS (SELECT srch_id, prop_id, price_usd, coalesce(m, gm) AS price_tier_mean, coalesce(med, gmed) AS price_tier_median,
      coalesce(s, CASE WHEN gs > 1e-6 THEN gs ELSE 1 END) AS price_tier_std, coalesce(n, 0) AS price_tier_count
      FROM log LEFT JOIN t ON srch_destination_id = td AND prop_starrating = ts CROSS JOIN g)
SELECT *, (price_usd - price_tier_mean) / price_tier_std AS price_z_in_tier,
      price_usd / greatest(price_tier_median, 1e0) AS price_vs_tier_median FROM d""",
    exact=ID + "price_tier_count", d6="price_z_in_tier price_vs_tier_median",
    d4="price_tier_mean price_tier_median price_tier_std",
)
def price_tier(ctx):
    return reference.price_tier(ctx.log, ctx.log)


@query(
    "F5_hotel_price_stats",
    """SELECT srch_id, prop_id, coalesce(m, (SELECT avg(price_usd) FROM log)) AS prop_id_price_mean,
      coalesce(s, 0) AS prop_id_price_std,
      price_usd - coalesce(m, (SELECT avg(price_usd) FROM log)) AS price_dev_from_prop_mean
      FROM log LEFT JOIN (SELECT prop_id AS hp, avg(price_usd) AS m, stddev_samp(price_usd) AS s FROM log GROUP BY 1)
      ON prop_id = hp""",
    exact=ID, d4="prop_id_price_mean prop_id_price_std price_dev_from_prop_mean",
)
def hotel_price(ctx):
    return reference.hotel_price_stats(ctx.log, ctx.log)


@query(
    "F6_hotel_price_stats_oof",
    """
, f AS (SELECT unnest(range(5)) AS f),
  g AS (SELECT f, avg(price_usd) AS gm FROM f JOIN scored ON fold <> f GROUP BY 1),
  h AS (SELECT f, prop_id AS hp, avg(price_usd) AS m, stddev_samp(price_usd) AS s FROM f JOIN scored ON fold <> f GROUP BY 1, 2)
SELECT srch_id, prop_id, coalesce(m, gm) AS prop_id_price_mean, coalesce(s, 0) AS prop_id_price_std,
      price_usd - coalesce(m, gm) AS price_dev_from_prop_mean
      FROM scored JOIN g ON g.f = fold LEFT JOIN h ON h.f = fold AND prop_id = hp""",
    exact=ID, d4="prop_id_price_mean prop_id_price_std price_dev_from_prop_mean",
)
def hotel_price_oof(ctx):
    return priors.hotel_price_stats_oof(ctx.folds, 5)


@query(
    "F7_impute_score2", IMPUTED_CTE + "\nSELECT srch_id, prop_id, prop_location_score2 FROM imputed",
    exact=ID, d6="prop_location_score2",
)
def impute(ctx):
    return reference.impute_score2(ctx.log, ctx.log)


@query(
    "F8_distance_features",
    """
, p AS (SELECT visitor_location_country_id AS v, prop_country_id AS c, median(orig_destination_distance) AS m
      FROM log GROUP BY 1, 2),
  d AS (SELECT srch_id, prop_id, orig_destination_distance AS x,
      coalesce(m, (SELECT median(orig_destination_distance) FROM log)) AS pm
      FROM log LEFT JOIN p ON visitor_location_country_id = v AND prop_country_id = c)
SELECT srch_id, prop_id, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS orig_distance_was_missing,
      pm AS orig_distance_country_pair_median, coalesce(x, pm) AS orig_distance_imputed,
      ln(1 + coalesce(x, pm)) AS log_distance_imputed FROM d""",
    exact=ID + "orig_distance_was_missing",
    d6="orig_distance_country_pair_median orig_distance_imputed log_distance_imputed",
)
def distance(ctx):
    return reference.distance_features(ctx.log, ctx.log)


@query(
    "F9_visitor_destination_popularity",
    """SELECT srch_id, prop_id, coalesce(n, 0) AS visitor_dest_popularity, ln(1 + coalesce(n, 0)) AS log_visitor_dest_popularity
      FROM log LEFT JOIN (SELECT visitor_location_country_id AS v, srch_destination_id AS d, count(*) AS n FROM log
      GROUP BY 1, 2) ON visitor_location_country_id = v AND srch_destination_id = d""",
    exact=ID + "visitor_dest_popularity", d6="log_visitor_dest_popularity",
)
def visitor_destination(ctx):
    return reference.visitor_destination_popularity(ctx.log, ctx.log)


@query(
    "F10_price_convention",
    """
, d AS (SELECT *, price_usd / greatest(srch_length_of_stay, 1) AS ppn FROM log),
  m AS (SELECT site_id AS s, prop_country_id AS c, median(ppn) AS med FROM d GROUP BY 1, 2),
  e AS (SELECT srch_id, prop_id, ppn, coalesce(med, (SELECT median(ppn) FROM d)) AS mk
      FROM d LEFT JOIN m ON site_id = s AND prop_country_id = c)
SELECT srch_id, prop_id, mk AS market_price_per_night_median, ppn / greatest(mk, 1e0) AS price_convention_residual FROM e""",
    exact=ID, d6="price_convention_residual", d4="market_price_per_night_median",
)
def price_convention(ctx):
    frame = rows.trip_features(ctx.log)
    return reference.price_convention(frame, frame)
