"""Ranking metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.base import SCORES, query
from rankloom.operators import factors, fusion, metrics
from rankloom.operators.sampling import train_validation_split
from rankloom.session import cut_lineage

ID = "srch_id prop_id "
REPORT = "n_searches n_rows"


def quality_cte(score: str, name: str = "q") -> str:
    """Per-search quality with two sorts, independent of the closed-form ideal."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY {score} DESC NULLS LAST, prop_id) AS k,
      row_number() OVER (PARTITION BY srch_id ORDER BY rel DESC) AS i FROM scored),
  {name} AS (SELECT srch_id, coalesce(sum(CASE WHEN k <= 5 THEN rel / log2(k + 1) END), 0) AS dcg,
      sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0 END) AS idcg,
      CAST(sum(CASE WHEN k <= 5 AND rel > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
      count(*) AS n, arg_min(is_domestic, prop_id) AS is_domestic, arg_min(is_family, prop_id) AS is_family FROM {name}_r GROUP BY 1)"""


NDCG = "coalesce(dcg / nullif(idcg, 0), 0)"
AGG = f"avg({NDCG}) AS ndcg5, coalesce(CAST(sum(hits) AS DOUBLE) / nullif(sum(positives), 0), 0) AS recall5, count(*) AS n_searches, CAST(sum(n) AS BIGINT) AS n_rows"


@query(
    "K1_search_quality", f"\n, {quality_cte('s1')}\nSELECT srch_id, dcg, idcg, {NDCG} AS ndcg, hits, positives, n AS n_rows FROM q",
    exact="srch_id hits positives n_rows", d6="dcg idcg ndcg",
)
def search_quality(ctx):
    return metrics.search_quality(ctx.scored, "s1")


@query(
    "I14_location_score_baseline", f"\n, {quality_cte('prop_location_score1')}\nSELECT {AGG} FROM q",
    exact=REPORT, d6="ndcg5 recall5",
)
def location_baseline(ctx):
    """No-model baseline: rank every search by the first location score."""
    return metrics.overall_metrics(ctx.log, "prop_location_score1")


@query("I14_svd_only_baseline")
def svd_baseline(ctx):
    """Rank held-out searches by the factors of the training searches alone: affinity, and cosine.

    Nine digits count, so that hotels without an interaction tie and end on their ids.
    """
    train, held = train_validation_split(ctx.log)
    keys = ["srch_id", "prop_id", "srch_destination_id", "booking_bool", "click_bool"]
    names = ["svd_affinity_score", "svd_cosine_similarity"]
    scored = factors.destination_hotel_factors(held.select(*keys), train, 20, flat=False)
    scored = cut_lineage(scored.withColumns({c: F.round(c, 9) + 0.0 for c in names}))
    parts = [metrics.overall_metrics(scored, c).withColumn("score", F.lit(c)) for c in names]
    return parts[0].unionByName(parts[1])


@query(
    "K1_any_relevance",
    """
, v AS (SELECT *, 2 * prop_starrating AS g FROM scored),
  r AS (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY s2 DESC NULLS LAST, prop_id) AS k, row_number() OVER (PARTITION BY srch_id ORDER BY g DESC) AS i FROM v)
SELECT srch_id, sum(CASE WHEN k <= 5 THEN g / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN g / log2(i + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1""",
    exact="srch_id", d6="dcg idcg",
)
def any_relevance(ctx):
    return metrics.ranked_relevance_quality(ctx.scored.withColumn("g", 2 * F.col("prop_starrating")), "s2", "g")


@query("K2_recall_at_5", f"\n, {quality_cte('s3')}\nSELECT {AGG} FROM q", d6="recall5")
def recall(ctx):
    return metrics.recall_at_k(ctx.scored, "s3")


SEGMENT_SQL = f"""SELECT 'is_domestic' AS segment, CAST(is_domestic AS VARCHAR) AS value, {AGG} FROM q GROUP BY 2
      UNION ALL SELECT 'is_family', CAST(is_family AS VARCHAR), {AGG} FROM q GROUP BY 2"""


@query("K3_segment_metrics", f"\n, {quality_cte('s3')}, sm AS ({SEGMENT_SQL})\nSELECT * FROM sm",
       exact="segment value " + REPORT, d6="ndcg5 recall5")
def segment_metrics(ctx):
    return metrics.segment_metrics(ctx.scored, "s3", ["is_domestic", "is_family"])


@query("K4_performance_ratio",
       f"\n, {quality_cte('s3')}, sm AS ({SEGMENT_SQL})\nSELECT segment, min(ndcg5) / max(ndcg5) AS epr FROM sm GROUP BY 1",
       exact="segment", d6="epr")
def ratio(ctx):
    return metrics.performance_ratio(metrics.segment_metrics(ctx.scored, "s3", ["is_domestic", "is_family"]))


@query(
    "K5_fairness_report",
    f"""
, {quality_cte('s3')}, sm AS ({SEGMENT_SQL}), o AS (SELECT 'overall' AS segment, 'all' AS value, {AGG} FROM q),
  e AS (SELECT segment, min(ndcg5) / max(ndcg5) AS epr FROM sm GROUP BY 1), al AS (SELECT * FROM sm UNION ALL SELECT * FROM o)
SELECT al.*, epr FROM al LEFT JOIN e USING (segment)""",
    exact="segment value " + REPORT, d6="ndcg5 recall5 epr",
)
def fairness(ctx):
    return metrics.fairness_report(ctx.scored, "s3", ["is_domestic", "is_family"])


@query(
    "K6_mixed_searches",
    """SELECT CAST(sum(m) AS BIGINT) AS mixed_count, avg(CAST(m AS DOUBLE)) AS mixed_fraction FROM
       (SELECT CASE WHEN count(DISTINCT is_domestic) > 1 THEN 1 ELSE 0 END AS m FROM scored GROUP BY srch_id)""",
    exact="mixed_count", d6="mixed_fraction",
)
def mixed(ctx):
    return metrics.mixed_searches(ctx.scored, "is_domestic")


@query(
    "K7_top5_overlap",
    """
, r AS (SELECT srch_id, row_number() OVER (PARTITION BY srch_id ORDER BY s1 DESC NULLS LAST, prop_id) AS a,
      row_number() OVER (PARTITION BY srch_id ORDER BY s2 DESC NULLS LAST, prop_id) AS b FROM scored)
SELECT avg(v) AS top5_overlap FROM (SELECT srch_id, CAST(sum(CASE WHEN a <= 5 AND b <= 5 THEN 1 ELSE 0 END) AS DOUBLE) / least(count(*), 5) AS v FROM r GROUP BY 1)""",
    d6="top5_overlap",
)
def overlap(ctx):
    return metrics.top_overlap(ctx.scored, "s1", "s2")


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in SCORES)


def pair_sql(columns, relation: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {relation}" for a in columns for b in columns
    )


@query("K8_spearman_matrix", f"\n, r AS (SELECT {_RANKS} FROM scored), p AS ({pair_sql(SCORES, 'r')})\nSELECT * FROM p",
       exact="column_a column_b", d6="r")
def spearman(ctx):
    return metrics.spearman_matrix(ctx.scored, SCORES)


@query(
    "K9_boost_before_after",
    f"""
, {quality_cte('s1', 'qa')}, {quality_cte('s1 + CASE WHEN is_domestic = 0 THEN 0.02e0 ELSE 0 END', 'qb')},
  u AS (SELECT 'before' AS stage, * FROM qa UNION ALL SELECT 'after', * FROM qb)
SELECT stage, is_domestic, {AGG} FROM u GROUP BY 1, 2""",
    exact="stage is_domestic " + REPORT, d6="ndcg5 recall5",
)
def before_after(ctx):
    boosted = fusion.segment_boost(ctx.scored, "s1", "boosted")
    tables = [
        metrics.segment_metrics(boosted, score, ["is_domestic"]).select(
            F.lit(stage).alias("stage"), F.col("value").cast("int").alias("is_domestic"), "ndcg5", "recall5", "n_searches", "n_rows"
        )
        for stage, score in (("before", "s1"), ("after", "boosted"))
    ]
    return tables[0].unionByName(tables[1])
