"""Score normalisation and fusion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankloom.catalog.base import SCORES, query
from rankloom.operators import blend_search, fusion

ID = "srch_id prop_id "
P = "OVER (PARTITION BY srch_id)"


def z(c: str) -> str:
    return f"({c} - avg({c}) {P}) / coalesce(nullif(stddev_samp({c}) {P}, 0), 1)"


def mm(c: str) -> str:
    return f"({c} - min({c}) {P}) / coalesce(nullif(max({c}) {P} - min({c}) {P}, 0), 1)"


def pos(c: str) -> str:
    return f"row_number() OVER (PARTITION BY srch_id ORDER BY {c} DESC NULLS LAST, prop_id)"


ZED = "z AS (SELECT *, " + ", ".join(f"{z(c)} AS {c}_z" for c in SCORES) + " FROM scored)"
# Fixed weights for the apply-only queries.
WEIGHTS = {"s1": 0.5, "s2": 0.25, "s3": 0.375, "s4": -0.125}
SEGMENTS = {"0": {"s1_z": 0.5, "s2_z": 0.5, "s3_z": 0.0, "s4_z": 0.0}, "1": {"s1_z": 0.25, "s2_z": 0.0, "s3_z": 0.75, "s4_z": 0.0}}
BLEND_SQL = "0.5e0 * s1_z + 0.25e0 * s2_z + 0.375e0 * s3_z - 0.125e0 * s4_z"


@query("J1_z_scores", "SELECT srch_id, prop_id, " + ", ".join(f"{z(c)} AS {c}_z" for c in SCORES) + " FROM scored",
       exact=ID, d6=" ".join(f"{c}_z" for c in SCORES))
def z_scores(ctx):
    return fusion.z_scores(ctx.scored, SCORES, ctx.big)


@query("J2_minmax_scores", "SELECT srch_id, prop_id, " + ", ".join(f"{mm(c)} AS {c}_mm" for c in SCORES) + " FROM scored",
       exact=ID, d6=" ".join(f"{c}_mm" for c in SCORES))
def minmax_scores(ctx):
    return fusion.minmax_scores(ctx.scored, SCORES, ctx.big)


@query(
    "J3_score_normalizations",
    "SELECT srch_id, prop_id, "
    + ", ".join(f"{z(c)} AS {c}_z, {mm(c)} AS {c}_mm, {pos(c)} / CAST(count(*) {P} AS DOUBLE) AS {c}_rank" for c in SCORES)
    + " FROM scored",
    exact=ID, d6=" ".join(f"{c}_{k}" for c in SCORES for k in ("z", "mm", "rank")),
)
def normalizations(ctx):
    return fusion.score_normalizations(ctx.scored, SCORES, ctx.big)


@query("J4_reciprocal_rank_fusion",
       "SELECT srch_id, prop_id, " + " + ".join(f"1e0 / (60 + {pos(c)})" for c in SCORES) + " AS rrf_score FROM scored",
       exact=ID, d6="rrf_score")
def rrf(ctx):
    return fusion.reciprocal_rank_fusion(ctx.scored, SCORES, oversized=ctx.big)


@query("J5_weighted_blend", f"\n, {ZED}\nSELECT srch_id, prop_id, {BLEND_SQL} AS signed_z_blend FROM z",
       exact=ID, d6="signed_z_blend")
def blend(ctx):
    return fusion.rebuild_blend(ctx.scored, WEIGHTS, oversized=ctx.big)


# A fixed list of weight vectors, scored in one pass per engine.
CANDIDATES = [
    blend_search.normalise(w, True)
    for w in ([1, 1, 1, 1], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [2, 1, 3, -1], [1, 2, -1, 0])
]


def _candidate_sql() -> str:
    rows = ", ".join(f"({i}, {', '.join(repr(v) + 'e0' for v in w)})" for i, w in enumerate(CANDIDATES))
    return f"""
, {ZED}, c(cand, w1, w2, w3, w4) AS (VALUES {rows}),
  b AS (SELECT cand, srch_id, prop_id, rel, round(w1 * s1_z + w2 * s2_z + w3 * s3_z + w4 * s4_z, 9) AS s FROM z CROSS JOIN c),
  r AS (SELECT *, row_number() OVER (PARTITION BY cand, srch_id ORDER BY s DESC NULLS LAST, prop_id) AS k,
      row_number() OVER (PARTITION BY cand, srch_id ORDER BY rel DESC) AS i FROM b),
  q AS (SELECT cand, srch_id, coalesce(sum(CASE WHEN k <= 5 THEN rel / log2(k + 1) END) / nullif(sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) END), 0), 0) AS n
      FROM r GROUP BY 1, 2)
SELECT cand, avg(n) AS ndcg5 FROM q GROUP BY cand"""


@query("J6_candidate_weights", _candidate_sql(), exact="cand", d6="ndcg5")
def candidate_weights(ctx):
    zed = fusion.z_scores(ctx.scored, SCORES, ctx.big)
    # scores are rounded so that equal blends tie in both engines
    lanes = F.array(*[
        F.struct(F.lit(i).alias("cand"), F.round(fusion.linear(dict(zip([f"{c}_z" for c in SCORES], w))), 9).alias("score"))
        for i, w in enumerate(CANDIDATES)
    ])
    from rankloom.operators.metrics import search_quality

    rows = zed.select("srch_id", "prop_id", "booking_bool", "click_bool", F.explode(lanes).alias("_l")).select(
        "srch_id", "prop_id", "booking_bool", "click_bool", "_l.*"
    )
    return search_quality(rows, "score", 5, keys=("cand", "srch_id")).groupBy("cand").agg(F.avg("ndcg").alias("ndcg5"))


def _fit_row(ctx, values: dict):
    fields = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return ctx.spark.createDataFrame([tuple(values.values())], fields)


def _zed(ctx):
    return fusion.z_scores(ctx.scored, SCORES, ctx.big)


_Z = [f"{c}_z" for c in SCORES]


@query("J6_fit_blend")
def fit_blend(ctx):
    fit = blend_search.fit_blend(_zed(ctx), _Z, signed=False)
    return _fit_row(ctx, {**fit.weights, "ndcg5": fit.ndcg, "oof_ndcg5": fit.oof_ndcg})


@query("J7_J8_fit_signed_blend_oof")
def fit_signed(ctx):
    fit = blend_search.fit_blend(_zed(ctx), _Z, signed=True)
    return _fit_row(ctx, {**fit.weights, "ndcg5": fit.ndcg, "oof_ndcg5": fit.oof_ndcg})


@query(
    "J9_apply_segment_blend",
    f"""
, {ZED}
SELECT srch_id, prop_id, CASE WHEN is_domestic = 0 THEN 0.5e0 * s1_z + 0.5e0 * s2_z
      ELSE 0.25e0 * s1_z + 0.75e0 * s3_z END AS segment_signed_z_blend FROM z""",
    exact=ID, d6="segment_signed_z_blend",
)
def segment_blend(ctx):
    return fusion.segment_blend(_zed(ctx), "is_domestic", SEGMENTS, {"s1_z": 1.0})


@query("J9_fit_segment_blend_oof")
def fit_segment(ctx):
    fit = blend_search.fit_segment_blend(_zed(ctx), _Z, "is_domestic")
    return _fit_row(ctx, {"segment": fit.segment, "oof_ndcg5": fit.oof_ndcg, "in_sample_ndcg5": fit.in_sample_ndcg})


@query(
    "J10_residual_blend",
    f"""
, {ZED}
SELECT srch_id, prop_id, s1_z + 0.2e0 * greatest(least(s3_z - s1_z, 3), -3) AS residual_meta_score FROM z""",
    exact=ID, d6="residual_meta_score",
)
def residual(ctx):
    return fusion.residual_blend(ctx.scored, "s1", "s3", 0.2, oversized=ctx.big)


@query("J11_residual_alpha_oof")
def residual_alpha(ctx):
    alpha, oof, folds = blend_search.residual_alpha(ctx.scored, "s1", "s3", [0.1, 0.2, 0.3, 0.4, 0.5])
    return _fit_row(ctx, {"alpha": alpha, "oof_ndcg5": oof, "mean_fold_alpha": sum(folds) / len(folds)})


@query("J12_J13_leave_one_model_out")
def leave_one_out(ctx):
    renamed = ctx.scored.withColumnsRenamed({"s1": "click_score", "s2": "lr_score", "s3": "pw_score"})
    kept, record = blend_search.leave_one_model_out(renamed, ["pw_score", "click_score", "lr_score"])
    rrf = fusion.reciprocal_rank_fusion(renamed, kept, oversized=ctx.big)
    from rankloom.operators.metrics import mean_ndcg

    with_model = next(iter(record.values()))["with_model"]
    chosen = blend_search.select_ensemble(with_model, mean_ndcg(rrf, "rrf_score"))
    rows = [(m, float(r["with_model"]), float(r["without_model"]), bool(r["kept"]), chosen["selected"]) for m, r in record.items()]
    return ctx.spark.createDataFrame(rows, "model string, with_model double, without_model double, kept boolean, selected string")


@query(
    "J14_segment_boost",
    "SELECT srch_id, prop_id, s1 + CASE WHEN is_domestic = 0 THEN 0.02e0 ELSE 0 END AS boosted FROM scored",
    exact=ID, d6="boosted",
)
def boost(ctx):
    return fusion.segment_boost(ctx.scored, "s1", "boosted")


@query(
    "J15_mean_score",
    "SELECT srch_id, prop_id, list_avg(list_filter([s1, prop_review_score, prop_location_score2], lambda x: x IS NOT NULL)) AS mean_score FROM scored",
    exact=ID, d6="mean_score",
)
def mean_score(ctx):
    return fusion.mean_score(ctx.scored, ["s1", "prop_review_score", "prop_location_score2"], "mean_score")


assert all(math.isclose(sum(map(abs, w)), 1, abs_tol=1e-9) for w in CANDIDATES)
