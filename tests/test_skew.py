"""The oversized-group routes give the same rows as the window routes."""

import numpy as np
import pytest
from conftest import SmallGroups, rows_of
from pyspark.sql import functions as F

from rankloom.functions import rows
from rankloom.models.objectives import LambdaRank, XeNdcg, YetiRank
from rankloom.operators import fusion, quantiles, relative, skew
from rankloom.operators.quantiles import bracket_quantiles, exact_quantiles


def same(spark, build, limit=6):
    plain = rows_of(build())
    with SmallGroups(spark, limit):
        assert skew.oversized_groups(build.__defaults__[0]) is not None
        split = rows_of(build())
    assert list(plain.columns) == list(split.columns) and len(plain) == len(split)
    for c in plain.columns:
        if plain[c].dtype.kind in "if":
            np.testing.assert_allclose(plain[c].astype(float), split[c].astype(float), atol=1e-9, err_msg=c)


CASES = {
    "relative": lambda df: relative.relative_block(df, ["price_usd", "prop_review_score"]),
    "size flags": relative.search_size_flags,
    "context": relative.search_context,
    "star rank": relative.star_price_rank,
    "dominance": lambda df: relative.dominance(rows.trip_features(df)),
    "pareto": lambda df: relative.price_quality_pareto(rows.trip_features(df)),
    "first value": lambda df: relative.first_value(df, "position"),
    "z, minmax, rank": lambda df: fusion.score_normalizations(df, ["prop_location_score1", "price_usd"]),
    "rrf": lambda df: fusion.reciprocal_rank_fusion(df, ["prop_location_score1", "position"]),
}


@pytest.mark.parametrize("name", CASES)
def test_operator(spark, log, name):
    same(spark, lambda df=log: CASES[name](df))


@pytest.mark.parametrize("objective", [LambdaRank(3), XeNdcg(), YetiRank(2)], ids=["lambda", "xendcg", "yeti"])
def test_gradients(spark, log, objective):
    base = log.select("srch_id", "prop_id", rows.relevance().alias("rel"), (F.col("price_usd") / 100).alias("score"))

    def build(df=base):
        return objective.gradients(df, 1, skew.oversized_groups(df))

    same(spark, build)


def test_one_group_with_most_rows_and_ties(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50 + 2).alias("srch_id"), F.col("id").alias("prop_id"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("x"),
    )
    with SmallGroups(spark, 1000):
        got = rows_of(skew.with_percent_rank(skew.with_position(df, "p", [F.col("x"), F.col("prop_id")]), {"r": "x"}))
    want = got.groupby("srch_id")["x"].rank(pct=True)
    np.testing.assert_allclose(got["r"], want)
    order = got.sort_values(["srch_id", "x", "prop_id"])
    assert (order["p"] == order.groupby("srch_id").cumcount() + 1).all()


@pytest.mark.parametrize("n", [1, 2, 7, 50_000])
def test_exact_quantiles_against_numpy(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 10007 + F.col("id") / 1e5).alias("x"))
    pdf = df.toPandas()
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for route in (exact_quantiles, bracket_quantiles):
        whole = route(df, [], "x", probs).first()
        for name, p in probs.items():
            assert whole[name] == pytest.approx(np.quantile(pdf["x"], p), abs=1e-9)
        for r in route(df, ["k"], "x", probs).collect():
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(pdf.loc[pdf["k"] == r["k"], "x"], p), abs=1e-9)


def test_value_ranks_routes_agree(spark, log):
    plain = rows_of(skew.value_ranks(log, [], "price_usd", small=True), "price_usd")
    ranged = rows_of(skew.value_ranks(log, [], "price_usd"), "price_usd")
    np.testing.assert_allclose(plain.astype(float), ranged.astype(float))


def test_quantiles_split_by_group_size(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 9).alias("k"), ((F.col("id") * 31) % 977).cast("double").alias("x"))
    pdf = df.toPandas()
    with SmallGroups(spark, 500):
        got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    assert got == pytest.approx(pdf.groupby("k")["x"].median().to_dict())


def quantiles_of(pdf, wanted):
    return {c: {out: np.quantile(pdf[c].dropna(), p) for out, p in probs.items()} for c, probs in wanted.items()}


@pytest.mark.parametrize("kept", [200, 4096])
def test_column_quantiles_by_narrowing(spark, monkeypatch, kept):
    """Sketches too small for the column: the brackets narrow scan by scan, ties and constants included."""
    monkeypatch.setattr(quantiles, "KEPT", kept)
    scans, inner = [], quantiles._scan
    monkeypatch.setattr(quantiles, "_scan", lambda *args: scans.append(args) or inner(*args))
    df = spark.range(3000).select(
        ((F.col("id") * 7919) % 10007 + F.col("id") / 1e5).alias("spread"), (F.col("id") % 3).cast("int").alias("ties"),
        F.lit(2.5).alias("constant"), F.when(F.col("id") % 7 == 0, F.col("id") * -1.5).alias("holes"),
        F.when(F.col("id") < 1500, 0.0).otherwise(1.0).alias("halves"), F.lit(None).cast("double").alias("empty"),
    )
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    wanted = {c: probs for c in df.columns}
    got = quantiles.column_quantiles(df, wanted)
    assert set(got.pop("empty").values()) == {None} and len(scans) <= (4 if kept == 200 else 1)
    pdf = df.drop("empty").toPandas()
    for c, probs in quantiles_of(pdf, {c: probs for c in got}).items():
        assert got[c] == pytest.approx(probs, abs=1e-9), c


def test_column_quantiles_when_sketches_mislead(spark, monkeypatch):
    """Brackets beside the wanted rank: the counts lead back, and the values stay exact."""
    monkeypatch.setattr(quantiles, "KEPT", 64)
    monkeypatch.setattr(quantiles, "_rank_error", lambda n: 0.0 if n <= 64 else 1e-4)
    df = spark.range(5000).select((F.col("id") * 37 % 4999).cast("double").alias("x"))
    wanted = {"x": {"a": 0.05, "b": 0.5, "c": 0.9}}
    assert quantiles.column_quantiles(df, wanted)["x"] == pytest.approx(quantiles_of(df.toPandas(), wanted)["x"])


def test_column_quantiles_of_odd_numbers(spark):
    rows = [float("nan"), 1.0, float("-inf"), 3.0, None, 2.0]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    got = quantiles.column_quantiles(df, {"x": {"low": 0.0, "mid": 0.5, "high": 1.0}})["x"]
    assert got["low"] == float("-inf") and got["mid"] == 2.0 and np.isnan(got["high"])
    assert quantiles.column_quantiles(df.limit(0), {"x": {"m": 0.5}}) == {"x": {"m": None}}


def test_missed_brackets_of_groups_are_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", 1e-9)
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 31) % 977).cast("double").alias("x"))
    passes, inner = [], quantiles._bracketed
    monkeypatch.setattr(quantiles, "_bracketed", lambda *args: passes.append(args[-1]) or inner(*args))
    got = {r["k"]: r["m"] for r in bracket_quantiles(df, ["k"], "x", {"m": 0.37}).collect()}
    assert len(passes) > 1 and got == pytest.approx(df.toPandas().groupby("k")["x"].quantile(0.37).to_dict())
