import numpy as np
import pytest
from conftest import flip_labels, rows_of, to_spark
from pyspark.sql import functions as F

from rankloom.operators import priors, reference
from rankloom.operators.sampling import train_validation_split, with_folds

RATES = [r.out for b in (*priors.TARGET_SET, priors.HOTEL_ALL_ROWS, *priors.VELOCITY_SET) for r in b.rates]


def encode(df):
    blocks = (*priors.TARGET_SET, priors.HOTEL_ALL_ROWS, *priors.VELOCITY_SET)
    return rows_of(priors.hierarchical_priors(priors.smoothed_priors(df, df, blocks, 5), df, 5))


def test_no_search_in_two_folds(log):
    assert with_folds(log).groupBy("srch_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_split_is_disjoint_and_whole(log):
    a, b = train_validation_split(log)
    assert a.count() + b.count() == log.count()
    assert a.join(b, "srch_id", "left_semi").isEmpty()


def test_own_fold_labels_never_reach_their_rows(spark, log_pdf):
    base = encode(with_folds(to_spark(spark, log_pdf)))
    fold = with_folds(to_spark(spark, log_pdf)).select("srch_id", "prop_id", "fold").toPandas()
    mask = log_pdf.merge(fold, on=["srch_id", "prop_id"])["fold"].to_numpy() == 2
    moved = encode(with_folds(to_spark(spark, flip_labels(log_pdf, mask))))
    own = base["fold"] == 2
    cols = RATES + ["lattice_prop_dest_book", "lattice_prop_stay_lift"]
    np.testing.assert_allclose(base.loc[own, cols], moved.loc[own, cols], atol=1e-12)
    assert (np.abs(base.loc[~own, cols] - moved.loc[~own, cols]).to_numpy() > 1e-6).any()


def test_holdout_uses_training_labels_only(spark, log, log_pdf):
    train, held = train_validation_split(log)
    a = rows_of(priors.oof_pair(with_folds(train), held, priors.TARGET_SET, 5)[1])
    flipped = to_spark(spark, flip_labels(log_pdf, np.ones(len(log_pdf), bool)))
    _, held2 = train_validation_split(flipped)
    b = rows_of(priors.oof_pair(with_folds(train), held2, priors.TARGET_SET, 5)[1])
    cols = [r.out for blk in priors.TARGET_SET for r in blk.rates]
    np.testing.assert_allclose(a[cols], b[cols])


def test_random_order_rates_ignore_other_rows(spark, log_pdf):
    cols = [r.out for b in priors.RANDOM_ORDER_SET for r in b.rates]
    run = lambda pdf: rows_of(priors.random_order_rates(to_spark(spark, pdf), to_spark(spark, pdf)))[cols]
    base = run(log_pdf)
    np.testing.assert_allclose(base, run(flip_labels(log_pdf, log_pdf["random_bool"] == 0)))
    assert not np.allclose(base, run(flip_labels(log_pdf, log_pdf["random_bool"] == 1)))


def test_smoothing_formula_and_unseen_keys(spark):
    schema = "prop_id long, random_bool int, click_bool int, booking_bool int"
    fit = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0), (3, 0, 1, 1)], schema)
    df = spark.createDataFrame([(1,), (2,), (3,)], "prop_id long")
    got = rows_of(priors.smoothed_priors(df, fit, [priors.HOTEL_RATES]), "prop_id")
    assert list(got["hotel_ctr_unbiased"]) == pytest.approx([(1 + 30 / 4) / 32, (30 / 4) / 32, 1 / 4])
    assert list(got["hotel_appearance_count"]) == [2, 2, 0]


def test_empty_fit_gives_zero(log):
    empty = log.where("srch_id < 0")
    got = rows_of(priors.smoothed_priors(log, empty, [priors.DESTINATION_STAR]))
    assert (got["dest_star_book_rate_unbiased"] == 0).all() and (got["dest_star_count_unbiased"] == 0).all()


def test_lattice_unseen_child_gets_overall_rate(log):
    fit, df = log.where("srch_destination_id <> 1005"), log.where("srch_destination_id = 1005")
    got = rows_of(priors.hierarchical_priors(df, fit))
    rate = fit.agg(F.avg("booking_bool")).first()[0]
    assert np.allclose(got["lattice_prop_dest_book"], rate)
    assert (got[["lattice_prop_dest_lift", "lattice_prop_dest_reliability"]] == 0).all().all()


def test_price_tier_fallbacks(spark, log):
    fit, df = log.where("srch_destination_id <> 1005"), log.where("srch_destination_id = 1005")
    got, pdf = rows_of(reference.price_tier(df, fit)), fit.toPandas()
    assert np.allclose(got["price_tier_mean"], pdf["price_usd"].mean())
    assert np.allclose(got["price_tier_median"], pdf["price_usd"].median())
    assert np.allclose(got["price_tier_std"], pdf["price_usd"].std()) and (got["price_tier_count"] == 0).all()
