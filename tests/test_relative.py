import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rankloom.functions import rows
from rankloom.operators import reference, relative


def test_against_pandas(log, log_pdf):
    got = rows_of(relative.search_size_flags(relative.relative_block(log)))
    want = log_pdf.sort_values(["srch_id", "prop_id"]).reset_index(drop=True)
    for c in relative.RELATIVE_COLUMNS:
        x = want[c].astype(float)
        g = x.groupby(want["srch_id"])
        for name, value in {
            "rank": g.rank(pct=True), "diff_mean": x - g.transform("mean"), "diff_median": x - g.transform("median"),
            "min": g.transform("min"), "max": g.transform("max"), "std": g.transform("std"),
        }.items():
            np.testing.assert_allclose(got[f"{c}_{name}"].astype(float), value, atol=1e-9, err_msg=f"{c}_{name}")
    assert (got["search_hotel_count"] == want.groupby("srch_id")["prop_id"].transform("count")).all()


def test_ranks_inside_each_search(spark):
    rows_ = [(1, i, p) for i, p in enumerate([100.0, 200.0, 300.0])] + [(2, i, p) for i, p in enumerate([3000.0, 1000.0, 2000.0])]
    df = spark.createDataFrame(rows_, "srch_id long, prop_id long, price_usd double")
    got = rows_of(relative.relative_block(df, ["price_usd"]))
    np.testing.assert_allclose(got["price_usd_rank"], [1 / 3, 2 / 3, 1, 1, 1 / 3, 2 / 3])


def test_row_order_does_not_matter(log):
    shuffled = log.orderBy(F.col("price_usd").desc()).repartition(3)
    a, b = relative.relative_block(log), relative.relative_block(shuffled)
    cols = ["srch_id", "prop_id", "price_usd_rank", "price_usd_diff_median"]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty()


def test_quartile_imputation(spark):
    ref = spark.createDataFrame(
        [(1, 0.1), (1, 0.2), (1, 0.3), (1, 0.4), (2, 0.9)], "prop_country_id int, prop_location_score2 double"
    )
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (1, 0.7)], "prop_country_id int, prop_location_score2 double")
    got = {(r[0], round(r[1], 6)) for r in reference.impute_score2(df, ref).select("prop_country_id", "prop_location_score2").collect()}
    assert got == {(1, 0.175), (2, 0.9), (3, 0.2), (1, 0.7)}


def test_pareto_against_the_scan(log):
    df = relative.price_quality_pareto(rows.trip_features(log))
    pdf = rows_of(df)
    for _, g in pdf.groupby("srch_id"):
        price = g["price_per_night"].fillna(np.inf).to_numpy()
        quality = g["prop_quality_score"].fillna(-np.inf).to_numpy()
        beaten = [any((price <= p) & (quality > q)) for p, q in zip(price, quality)]
        assert list(1 - np.array(beaten, int)) == list(g["is_price_quality_pareto"])


def test_feature_operators_keep_the_row_count(log):
    n = log.count()
    for fn in (rows.price_features, rows.competitor_features, rows.trip_features, relative.search_context, relative.dominance):
        assert fn(log).count() == n


def test_unit_bucket_borders(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 2, 7, 8, 14, 30, 90, 365, 366, 9999, 10000)], "srch_booking_window int")
    got = [r[0] for r in rows.with_window_bucket(df).select("booking_window_bucket").collect()]
    assert got == [None, 0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 7, None]


def test_target_free_filter_blocks_every_target_column():
    from rankloom.models.assemble import is_target_derived, target_free
    from rankloom.operators.priors import HOTEL_ALL_ROWS, HOTEL_CONTEXT_SET, LATTICES, RANDOM_ORDER_SET, TARGET_SET, VELOCITY_SET

    for block in (*RANDOM_ORDER_SET, *HOTEL_CONTEXT_SET, *TARGET_SET, *VELOCITY_SET, HOTEL_ALL_ROWS):
        for name in [r.out for r in block.rates] + ([block.count] if block.count else []):
            assert is_target_derived(name) and is_target_derived(f"{name}_rank")
    assert all(is_target_derived(f"{p}_book") for p in LATTICES)
    assert target_free(["price_usd", "svd_dest_f3", "hotel_ctr_unbiased_gap_best", "prop_id_count"]) == ["price_usd", "prop_id_count"]


@pytest.mark.parametrize("cols", [["position", "price_usd", "comp1_rate", "fold", "prop_id"]])
def test_feature_list_drops_labels_and_raw_competitors(cols):
    assert rows.feature_columns(cols) == ["price_usd", "prop_id"]
