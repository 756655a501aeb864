import math
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rankloom.functions.rows import relevance
from rankloom.models import rankers
from rankloom.models.assemble import assemble
from rankloom.models.boost import fit_ranker, snapshot_weights
from rankloom.models.ensemble import ensemble
from rankloom.models.objectives import LambdaRank, XeNdcg, YetiRank
from rankloom.operators import metrics

FEATURES = ["price_usd", "prop_location_score1", "prop_review_score", "position", "hint"]


@pytest.fixture(scope="module")
def frame(log):
    hint = F.col("booking_bool") * 2 + F.col("click_bool") + F.col("price_usd") / 300
    return log.withColumns({
        "hint": hint, "is_domestic": (F.col("visitor_location_country_id") == F.col("prop_country_id")).cast("int"),
    }).cache()


def test_lambdarank_gradient_against_all_pairs(log):
    t = 4
    base = log.select("srch_id", "prop_id", relevance().alias("rel"), (F.col("price_usd") / 50).alias("score"))
    got = rows_of(LambdaRank(t).gradients(base, 0))
    for _, g in got.groupby("srch_id"):
        g = g.sort_values(["score", "prop_id"], ascending=[False, True])
        rel, s = g["rel"].to_numpy(), g["score"].to_numpy()
        ideal = sum(r / math.log2(i + 2) for i, r in enumerate(sorted(rel, reverse=True)[:t]))
        grad, hess = np.zeros(len(g)), np.zeros(len(g))
        for i in range(len(g)):
            for j in range(len(g)):
                if rel[i] > rel[j] and min(i, j) < t and ideal > 0:
                    rho = 1 / (1 + math.exp(s[i] - s[j]))
                    d = abs(rel[i] - rel[j]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / ideal
                    grad[i] -= rho * d
                    grad[j] += rho * d
                    hess[[i, j]] += rho * (1 - rho) * d
        np.testing.assert_allclose(g["_g"], grad, atol=1e-9)
        np.testing.assert_allclose(g["_h"], hess, atol=1e-9)


def test_listwise_gradients_sum_to_zero(log):
    base = log.select("srch_id", "prop_id", relevance().alias("rel"), (F.col("price_usd") / 50).alias("score"))
    for objective in (XeNdcg(), YetiRank(2), LambdaRank(30)):
        sums = objective.gradients(base, 3).groupBy("srch_id").agg(F.sum("_g").alias("s")).toPandas()["s"]
        assert np.abs(sums).max() < 1e-9


@pytest.mark.parametrize("objective", [LambdaRank(30), LambdaRank(5), XeNdcg(), YetiRank(2)], ids=["lambda", "lambda5", "xendcg", "yeti"])
def test_boosting_raises_training_ndcg(frame, objective):
    model = fit_ranker(frame, FEATURES, objective, rounds=3, rate=0.5, depth=3, min_rows=5, validation=frame)
    assert model.history[-1] > 0.6 and model.history[-1] >= model.history[0] - 0.02
    scored = frame.join(model.predict(frame, "s", snapshots=None), ["srch_id", "prop_id"])
    assert metrics.mean_ndcg(scored, "s") == pytest.approx(model.history[model.best_round - 1], abs=1e-6)


def test_score_cut_does_not_change_the_model(frame, monkeypatch):
    from rankloom.models import boost

    run = lambda: rows_of(fit_ranker(frame, FEATURES, XeNdcg(), rounds=4, depth=2, min_rows=5).predict(frame, "s", None))["s"]
    once = run()
    monkeypatch.setattr(boost, "CUT_EVERY", 1)
    np.testing.assert_allclose(once, run(), atol=1e-9)


def test_one_projection_for_five_hundred_trees(frame):
    """The assembled model gives the sums of a chain of single trees, and its plan does not grow with trees."""
    model = fit_ranker(frame, FEATURES, XeNdcg(), rounds=4, depth=2, min_rows=5)
    many = replace(model, trees=model.trees * 125, best_round=500)
    scored = many.predict(frame, "s")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert len(plan) == len(replace(many, trees=model.trees, best_round=4).predict(frame, "s")._jdf.queryExecution().executedPlan().toString())
    got = rows_of(scored)["s"]
    rows = assemble(frame, FEATURES, ("srch_id", "prop_id"))
    each = [rows_of(t.setPredictionCol("t").transform(rows).select("srch_id", "prop_id", "t"))["t"] for t in model.trees]
    shares = snapshot_weights(500)
    want = sum(model.rate * w * each[i % 4] for i, w in enumerate(shares))
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        ensemble([], [], 1)


def test_snapshot_weights():
    assert snapshot_weights(1) == [1.0]
    w = snapshot_weights(100)
    assert w[91] == 1 and w[92] == pytest.approx(2 / 3) and w[99] == pytest.approx(1 / 3)


def test_binary_model(frame):
    model = rankers.fit_binary(frame, frame, FEATURES, "booking_bool", rounds=3, depth=3)
    got = rows_of(frame.join(model.predict(frame, "p"), ["srch_id", "prop_id"]))
    assert got["p"].between(0, 1).all()
    assert got.loc[got["booking_bool"] == 1, "p"].mean() > got.loc[got["booking_bool"] == 0, "p"].mean()


def test_seed_average_and_weights(frame):
    scores, models = rankers.xendcg_average(frame, None, FEATURES, frame, seeds=(1, 2), rounds=1, depth=2, min_rows=5)
    assert scores.count() == frame.count() and len(models) == 2
    weights = rankers.international_weight(frame).groupBy("srch_id").agg(F.count_distinct("query_weight").alias("n"))
    assert weights.where("n > 1").isEmpty()


def test_sort_emulator_covers_every_row(frame):
    train, held = rankers.sort_emulator(frame, frame.limit(50), n_folds=2, rounds=1)
    assert train.where("sort_emulator_score is null").isEmpty() and train.count() == frame.count()
    assert held.where("sort_emulator_rank is null").isEmpty()


def test_reranker_keeps_candidates_on_top(frame):
    df = frame.withColumns({"a": F.col("prop_location_score1"), "b": -F.col("price_usd")})
    scored, _ = rankers.fit_reranker(df, ["a", "b"], "a", k=2, rounds=1, depth=2, min_rows=5)
    got = rows_of(scored)
    low = got[got["is_candidate"] == 1].groupby("srch_id")["topk_rerank_score"].min()
    high = got[got["is_candidate"] == 0].groupby("srch_id")["topk_rerank_score"].max()
    assert (low.loc[high.index] > high).all() and len(got) == frame.count()


def test_meta_stacker(frame):
    df = frame.select("srch_id", "prop_id", "booking_bool", "click_bool", "is_domestic", F.col("hint").alias("a"), (-F.col("price_usd")).alias("b"))
    meta, features = rankers.meta_frame(df, ["a", "b"])
    assert "is_domestic" in features
    result = rankers.fit_meta(meta, features, n_folds=2, rounds=1, depth=2, min_rows=5)
    assert result.scores.count() == frame.count() and len(result.fold_scores) == 2
    assert rows_of(result.model.importances(frame.sparkSession), "feature").shape[0] == len(features)


def test_small_gains_keep_all_rounds_and_a_turn_stops_at_the_best():
    slow = [0.6 * 0.998 ** i for i in range(40)]
    assert rankers.best_length(slow, 10) == 40
    turn = [1.0, 0.8, 0.7, 0.75, 0.71, 0.72, 0.6]
    assert rankers.best_length(turn, 3) == 3
    assert rankers.best_length(turn, 10) == 7


def test_binary_model_counts_the_rounds_the_held_rows_choose(log):
    features = ["price_usd", "prop_location_score1", "prop_starrating"]
    train, held = log.where("srch_id % 4 <> 0"), log.where("srch_id % 4 = 0")
    model = rankers.fit_binary(train, held, features, "click_bool", rounds=8, depth=2, patience=3)
    assert len(model.model.trees) == 8 and 1 <= model.best_round <= 8
    assert rankers.fit_binary(train, None, features, "click_bool", rounds=3, depth=2).best_round == 3
