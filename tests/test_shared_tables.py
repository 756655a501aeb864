"""Fits that share one feature table, and running sums over stretches of a hash."""

import pytest
from conftest import SmallGroups, rows_of
from pyspark.sql import functions as F

from rankloom.functions.rows import relevance
from rankloom.models import boost, rankers
from rankloom.models.objectives import XeNdcg
from rankloom.operators import ordered, sampling

FEATURES = ["price_usd", "prop_starrating", "prop_location_score1"]


def counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or plain(*a, **k))
    return calls


def test_seeds_and_folds_write_their_features_once(monkeypatch, log):
    calls, held = counted(monkeypatch, boost, "stage_buckets"), counted(monkeypatch, boost, "cut_lineage")
    rankers.xendcg_average(log, log, FEATURES, log, seeds=(1, 2, 3), rounds=1, depth=2, min_rows=5)
    assert (len(calls), len(held)) == (1, 1)
    calls.clear()
    rankers.fit_meta(log, FEATURES, n_folds=3, rounds=1, depth=2, min_rows=5)
    assert (len(calls), len(held)) == (1, 1)


def test_a_round_moves_no_features(log):
    table = boost.feature_table(log, FEATURES)
    graded = XeNdcg().gradients(sampling.drop_negatives(table.rows, 0.35, 1, placed=True), 0, None)
    assert "Exchange" not in graded._jdf.queryExecution().executedPlan().toString()


def test_shared_table_gives_the_models_of_their_own_tables(log):
    _, shared = rankers.xendcg_average(log, log, FEATURES, log, seeds=(1, 2), rounds=2, depth=2, min_rows=5)
    for seed, model in zip((1, 2), shared):
        own = rankers.fit_xendcg(log, log, FEATURES, seed, rounds=2, depth=2, min_rows=5)
        assert model.history == pytest.approx(own.history)
        scores = [list(rows_of(m.predict(log, "s", None))["s"]) for m in (model, own)]
        assert scores[0] == pytest.approx(scores[1])


def test_placed_rows_drop_the_same_negatives(log):
    rows = log.unionByName(log.limit(3).withColumn("srch_id", F.lit(None).cast("int")))
    for frac in (0.35, 0.99):
        kept = [sorted(map(tuple, sampling.drop_negatives(rows, frac, 3, placed).select("srch_id", "prop_id").collect(), ), key=str)
                for placed in (False, True)]
        assert kept[0] == kept[1]


def test_hot_ids_need_no_range_sort(monkeypatch, spark, log):
    from rankloom.operators import skew

    monkeypatch.setattr(skew, "range_chunks", None)
    with SmallGroups(spark, 25):
        small = rows_of(ordered.ordered_target_statistics(log, ["site_id", "prop_id"], relevance() / 5))
    whole = rows_of(ordered.ordered_target_statistics(log, ["site_id", "prop_id"], relevance() / 5))
    for c in ("site_id_ordered", "prop_id_ordered"):
        assert list(small[c]) == pytest.approx(list(whole[c]), abs=1e-12)
