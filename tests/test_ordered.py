"""Ordered target statistics against a plain loop, hot ids and the rows' own labels included."""

import hashlib

import pytest
from conftest import SmallGroups, flip_labels, rows_of, to_spark
from pyspark.sql import functions as F

from rankloom.functions.rows import relevance
from rankloom.models import rankers
from rankloom.operators.ordered import PRIOR, encode_ids, ordered_target_statistics, target_statistics

IDS = ["prop_id", "srch_destination_id", "site_id"]


def plain(pdf, c):
    key = lambda r: (int(hashlib.md5(f"42:{r.srch_id}:{r.prop_id}".encode()).hexdigest()[:8], 16), r.srch_id, r.prop_id)
    seen, out = {}, {}
    for r in sorted(pdf.itertuples(), key=key):
        total, n = seen.get(getattr(r, c), (0.0, 0))
        out[r.srch_id, r.prop_id] = (total + PRIOR) / (n + 1)
        seen[getattr(r, c)] = total + (5 if r.booking_bool else r.click_bool) / 5, n + 1
    return out


@pytest.mark.parametrize("limit", [1_000_000, 25])
def test_against_a_plain_loop(spark, log, log_pdf, limit):
    """25 rows: every destination and site is oversized and goes through chunks with carried sums."""
    with SmallGroups(spark, limit):
        got = rows_of(ordered_target_statistics(log, IDS, relevance() / 5))
    assert len(got) == len(log_pdf)
    for c in IDS:
        want = plain(log_pdf, c)
        assert [want[k] for k in zip(got["srch_id"], got["prop_id"])] == pytest.approx(list(got[f"{c}_ordered"]), abs=1e-12)


def test_own_label_does_not_reach_the_encoding(spark, log_pdf):
    encoded = lambda pdf: rows_of(ordered_target_statistics(to_spark(spark, pdf), IDS, relevance() / 5))
    row = log_pdf.index == 17
    before, after = encoded(log_pdf), encoded(flip_labels(log_pdf, row))
    own = (before["srch_id"] == log_pdf.srch_id[17]) & (before["prop_id"] == log_pdf.prop_id[17])
    columns = [f"{c}_ordered" for c in IDS]
    assert (before.loc[own, columns].to_numpy() == after.loc[own, columns].to_numpy()).all()
    assert (before[columns].to_numpy() != after[columns].to_numpy()).any()  # later rows do see it


def test_unseen_and_null_ids_and_missing_labels(spark):
    rows = [(1, 7, 1.0), (2, 7, None), (3, 7, 0.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "srch_id long, a long, y double").withColumn("prop_id", F.lit(1))
    got = {r.srch_id: r.a_ordered for r in ordered_target_statistics(df, ["a"], F.col("y")).collect()}
    assert got[4] == PRIOR and len(got) == 4
    tables = target_statistics(df, ["a"], F.col("y"))
    new = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "srch_id long, a long")
    assert {r.srch_id: r.a_ordered for r in encode_ids(new, tables).collect()} == pytest.approx({1: (1 + PRIOR) / 3, 2: PRIOR, 3: PRIOR})
    assert ordered_target_statistics(df.limit(0), ["a"], F.col("y")).collect() == []


def test_noisy_ranking_model_reads_ids(log):
    model = rankers.fit_yetirank(log, None, ["price_usd", "prop_id"], rounds=1, depth=2, min_rows=5)
    assert model.features == ["price_usd", *[f"{c}_ordered" for c in rankers.CATEGORY_IDS]]
    assert model.predict(log, "s", None).where("s IS NULL").count() == 0
