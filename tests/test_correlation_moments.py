"""Correlations from moments of batches, without a row per pair."""

import math

import numpy as np
import pyarrow as pa
import pytest

from rankloom.operators.metrics import _merged, _moments, correlation_pairs


def test_rows_are_not_expanded_to_pairs(spark):
    df = spark.createDataFrame([(0.1 * i, 2.0 - i) for i in range(20)], "a double, b double")
    plan = correlation_pairs(df, [("a", "b", "a", "b")])._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("MapInArrow"):]
    assert "Generate" not in scan


@pytest.mark.parametrize("parts", [1, 5])
def test_moments_equal_numpy(spark, parts):
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(size=500)
    y = 0.3 * (x - 1e6) + rng.normal(size=500)
    data = [(float(a), float(b) if i % 7 else None, 0.1, None, math.nan if i == 3 else 1.0 * i) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x double, y double, same double, none double, bad double").repartition(parts)
    pairs = [(a, b, a, b) for a, b in [("x", "y"), ("y", "x"), ("x", "x"), ("x", "same"), ("x", "none"), ("x", "bad")]]
    got = {(r.column_a, r.column_b): r.r for r in correlation_pairs(df, pairs).collect()}
    kept = np.arange(500) % 7 > 0
    want = np.corrcoef(x[kept], y[kept])[0, 1]
    assert got["x", "y"] == pytest.approx(want, rel=1e-9) and got["y", "x"] == got["x", "y"]
    assert got["x", "x"] == pytest.approx(1.0) and got["x", "same"] is None and ("x", "none") not in got
    assert math.isnan(got["x", "bad"])


def test_parts_merge_in_any_order():
    rng = np.random.default_rng(2)
    values = rng.normal(size=(60, 2)) + [0.1, 5.0]
    batches = [pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], names=["_0", "_1"]) for v in np.split(values, 6)]
    parts = pa.Table.from_batches([b for one in batches for b in _moments(iter([one]), [(0, 1)])])
    a, b = _merged(parts), _merged(parts.take(list(range(5, -1, -1))))
    assert a.equals(b)
    assert a["xy"][0].as_py() / 60 == pytest.approx(np.cov(values.T, bias=True)[0, 1])
