import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rankloom.operators import blend_search, fusion, metrics
from rankloom.operators.sampling import fold_of


def frame(spark, values):
    return spark.createDataFrame([(s, i, float(v)) for i, (s, v) in enumerate(values)], "srch_id long, prop_id long, score double")


def test_z_scores_edge_cases(spark):
    got = rows_of(fusion.z_scores(frame(spark, [(1, 4), (1, 4), (1, 4), (2, 9), (3, 1), (3, 3)]), ["score"]))
    assert list(got["score_z"][:4]) == [0, 0, 0, 0]
    assert list(got["score_z"][4:]) == pytest.approx([-0.5 ** 0.5, 0.5 ** 0.5])


def test_z_scores_ignore_a_shift_and_keep_ndcg(log):
    df = log.withColumns({"a": F.col("price_usd"), "b": F.col("price_usd") + 1000 * F.col("srch_id")})
    got = rows_of(fusion.z_scores(df, ["a", "b"]))
    np.testing.assert_allclose(got["a_z"], got["b_z"], atol=1e-6)
    zed = fusion.z_scores(df, ["a"])
    assert metrics.mean_ndcg(zed, "a_z") == pytest.approx(metrics.mean_ndcg(zed, "a"))


def test_one_model_takes_all_weight(log):
    df = fusion.z_scores(log, ["prop_location_score1"])
    fit = blend_search.fit_blend(df, ["prop_location_score1_z"], signed=False, n_folds=4, rounds=1)
    assert fit.weights == {"prop_location_score1_z": 1.0}


@pytest.mark.parametrize("signed", [False, True])
def test_blend_fit(log, signed):
    df = log.withColumns({
        "good": 3.0 * F.col("booking_bool") + F.col("prop_location_score1"), "bad": -F.col("booking_bool").cast("double"),
    })
    zed = fusion.z_scores(df, ["good", "bad"])
    fit = blend_search.fit_blend(zed, ["good_z", "bad_z"], signed, n_folds=4, rounds=4)
    assert sum(abs(w) for w in fit.weights.values()) == pytest.approx(1)
    assert signed or min(fit.weights.values()) >= 0
    blended = fusion.weighted_blend(zed, fit.weights, "blend")
    assert fit.ndcg == pytest.approx(metrics.mean_ndcg(blended, "blend"))
    assert fit.ndcg >= metrics.mean_ndcg(fusion.weighted_blend(zed, {"good_z": 0.5, "bad_z": 0.5}, "b"), "b") - 1e-9
    assert 0 <= fit.oof_ndcg <= 1


def _three_scores(log):
    df = log.withColumns({
        "a": F.col("prop_location_score1"), "b": -F.col("price_usd"), "c": F.coalesce("prop_location_score2", F.lit(0.0)),
        "is_domestic": (F.col("visitor_location_country_id") == F.col("prop_country_id")).cast("int"),
    })
    return fusion.z_scores(df, ["a", "b", "c"]).cache()


Z = ["a_z", "b_z", "c_z"]


def test_labels_of_a_fold_do_not_move_its_weights(log):
    zed = _three_scores(log)
    held = fold_of(3) == 1
    other = zed.withColumns({
        "booking_bool": F.when(held, (F.col("prop_id") % 3 == 0).cast("int")).otherwise(F.col("booking_bool")),
        "click_bool": F.when(held, (F.col("prop_id") % 3 == 0).cast("int")).otherwise(F.col("click_bool")),
    })
    before, after = (blend_search.fit_blend(x, Z, True, n_folds=3, rounds=3) for x in (zed, other))
    assert before.fold_weights[1] == after.fold_weights[1]
    assert before.fold_weights != after.fold_weights or before.weights != after.weights
    parts = [blend_search.fit_segment_blend(x, Z, "is_domestic", n_folds=3, rounds=2, overall=fit)
             for x, fit in ((zed, before), (other, after))]
    assert parts[0].fold_segments[1] == parts[1].fold_segments[1]
    assert parts[0].segments != parts[1].segments


def test_every_fold_has_the_search_of_a_fit_without_it(log):
    """A fold's weights are those of a whole fit on the other folds' searches."""
    zed = _three_scores(log)
    fit = blend_search.fit_blend(zed, Z, True, n_folds=3, rounds=3)
    for f in range(3):
        alone = blend_search.fit_blend(zed.where(fold_of(3) != f), Z, True, n_folds=3, rounds=3)
        assert alone.weights == fit.fold_weights[f]


def test_jobs_do_not_grow_with_folds_or_segments(log, monkeypatch):
    zed, calls = _three_scores(log), []
    plain = blend_search.Pool.evaluate
    monkeypatch.setattr(blend_search.Pool, "evaluate", lambda self, wanted: calls.append(len(wanted)) or plain(self, wanted))
    for n_folds in (2, 6):
        blend_search.fit_blend(zed, Z, n_folds=n_folds, rounds=2)
    assert calls == [1] * 6
    calls.clear()
    blend_search.fit_segment_blend(zed, Z, "is_domestic", n_folds=4, rounds=2)
    assert calls == [1] * 3 + [2] * 3
    with pytest.raises(ValueError):
        blend_search.fit_segment_blend(zed, Z, "is_domestic", n_folds=2, rounds=1, max_values=1)


def test_segment_fit_and_apply(log):
    df = log.withColumns({
        "a": F.col("prop_location_score1"), "b": -F.col("price_usd"),
        "is_domestic": (F.col("visitor_location_country_id") == F.col("prop_country_id")).cast("int"),
    })
    zed = fusion.z_scores(df, ["a", "b"]).cache()
    fit = blend_search.fit_segment_blend(zed, ["a_z", "b_z"], "is_domestic", n_folds=3, rounds=2)
    assert set(fit.segments) == {"0", "1"} and 0 <= fit.oof_ndcg <= 1
    for w in fit.segments.values():
        assert sum(map(abs, w.values())) == pytest.approx(1)
    got = rows_of(fusion.segment_blend(zed, "is_domestic", fit.segments, fit.default))
    want = [fit.segments[str(d)]["a_z"] * x + fit.segments[str(d)]["b_z"] * y for d, x, y in zip(got["is_domestic"], got["a_z"], got["b_z"])]
    np.testing.assert_allclose(got["segment_signed_z_blend"], want)


def test_residual_alpha_matches_direct_scoring(log):
    df = log.withColumns({"a": F.col("prop_location_score1"), "b": -F.col("price_usd")})
    alpha, oof, per_fold = blend_search.residual_alpha(df, "a", "b", [0.1, 0.5], n_folds=3)
    direct = {x: metrics.mean_ndcg(fusion.residual_blend(df, "a", "b", x, "r"), "r") for x in (0.1, 0.5)}
    assert direct[alpha] == pytest.approx(max(direct.values())) and len(per_fold) == 3 and 0 <= oof <= 1


def test_selector_gates():
    pick = blend_search.select_ensemble
    assert pick(0.42, 0.41)["selected"] == "signed_z_blend"
    assert pick(0.42, 0.41, segment_oof=0.4201)["selected"] == "signed_z_blend"
    assert pick(0.42, 0.41, segment_oof=0.4203)["selected"] == "segment_signed_z_blend"
    assert pick(0.42, 0.41, residual_oof=0.43, meta_fold_scores=[0.41, 0.412])["selected"] == "residual_meta_score"
    assert pick(0.42, 0.41, residual_oof=0.43, meta_fold_scores=[0.40, 0.45])["selected"] == "signed_z_blend"
    assert not pick(0.42, 0.41, rules=blend_search.SelectorRules(gate=0.5))["passes_gate"]
