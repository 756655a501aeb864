"""Quantiles of columns: what the scans after the first bracket read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import quantiles


def test_later_scans_read_only_the_values_that_are_left(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "KEPT", 200)
    read, inner = [], quantiles._scan
    monkeypatch.setattr(quantiles, "_scan", lambda cells: read.append(cells.count()) or inner(cells))
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("x"), F.lit(1.5).alias("same"))
    got = quantiles.column_quantiles(df, {"x": {"low": 0.1, "mid": 0.5}, "same": {"mid": 0.5}})
    values = df.toPandas()["x"]
    assert got["x"] == pytest.approx({"low": np.quantile(values, 0.1), "mid": np.quantile(values, 0.5)}) and got["same"] == {"mid": 1.5}
    assert read[0] == 40_000 and len(read) > 1 and max(read[1:]) < 10_000


def test_zones_of_a_value():
    cuts = [1.0, 2.0, 5.0]
    tree = quantiles._zone(cuts, str)
    zone = lambda x: next(2 * i + (x == c) for i, c in enumerate(cuts) if x <= c) if x <= 5 else 6
    assert tree.count("WHEN") == 6 and all(f"THEN {zone(x)}" in tree or f"ELSE {zone(x)}" in tree for x in (0, 1, 1.5, 2, 3, 5, 6))
