import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics


def ranked(spark, labels, srch=1):
    """Rows with falling scores; label 'b' booking, 'c' click, '-' nothing."""
    return [(srch, i, float(-i), int(x == "b"), int(x in "bc")) for i, x in enumerate(labels)]


def ndcg(spark, *groups):
    rows = [r for s, g in enumerate(groups) for r in ranked(spark, g, s)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, score double, booking_bool int, click_bool int")
    return metrics.mean_ndcg(df, "score")


def test_perfect_order_is_one(spark):
    assert ndcg(spark, "bc---") == pytest.approx(1)


def test_positive_below_cut_off_is_zero(spark):
    assert ndcg(spark, "-----b") == 0


def test_hand_computed_case(spark):
    l2 = math.log2
    got = 1 / l2(3) + 5 / l2(4)
    best = 5 + 5 / l2(3) + 1 / l2(4)
    assert ndcg(spark, "-cb--b") == pytest.approx(got / best)


def test_booking_counts_five_not_six(spark):
    assert ndcg(spark, "-b---") == pytest.approx(1 / math.log2(3))


def test_empty_search_is_zero_and_stays_in_the_mean(spark):
    assert ndcg(spark, "b----", "-----") == pytest.approx(0.5)


def test_closed_form_ideal_equals_two_sorts(spark, log):
    df = log.withColumns({"score": F.col("price_usd"), "rel": F.expr("5 * booking_bool + greatest(click_bool - booking_bool, 0)")})
    a = metrics.search_quality(df, "score").select("srch_id", F.round("ndcg", 12).alias("n"))
    b = metrics.ranked_relevance_quality(df, "score", "rel").select("srch_id", F.round("ndcg", 12).alias("n"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_null_scores_rank_last(spark):
    rows = [(1, 1, None, 1, 1), (1, 2, 0.1, 0, 0)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, score double, booking_bool int, click_bool int")
    assert metrics.mean_ndcg(df, "score") == pytest.approx(1 / math.log2(3))


def test_top_k_is_limited_before_the_shuffle(spark, log):
    df = metrics.search_quality(log, "price_usd")
    plan = df._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_overlap_of_a_ranking_with_itself(spark, log):
    row = metrics.top_overlap(log, "price_usd", "price_usd").first()
    assert row[0] == pytest.approx(1)


def test_performance_ratio(spark):
    table = spark.createDataFrame([("s", "0", 0.4), ("s", "1", 0.5)], "segment string, value string, ndcg5 double")
    assert metrics.performance_ratio(table).first()["epr"] == pytest.approx(0.8)
