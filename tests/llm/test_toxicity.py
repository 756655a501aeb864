from math import comb

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm.toxicity import SeverityModel, _fit, _loss_parts, _stacked, fit_severity, reject_toxic, upper_tail, with_severity

from .helpers import CLASH, docs, prose

BAD = {1: "darn", 2: "rotten", 3: "vile"}


def graded(spark, n=400):
    texts, grades = [], []
    for i in range(n):
        grade = i % 4
        texts.append(prose(i, 40) + (f" {BAD[grade]} {prose(i + n, 5)} {BAD[grade]}!" if grade else ""))
        grades.append(grade)
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 3], "doc_id long, toxic int")
    return docs(spark, texts, **CLASH), labels, grades


def test_ordered_grades_are_learnt_and_held_out_rows_agree(spark):
    frame, labels, grades = graded(spark)
    model = fit_severity(frame, labels)
    assert model.grades == [0, 1, 2, 3] and model.thresholds == sorted(model.thresholds)
    scored = {r.doc_id: r.severity for r in with_severity(frame, model).select("doc_id", "severity").collect()}
    held = [i for i in range(400) if i % 3 == 0]
    mean = [np.mean([scored[i] for i in held if grades[i] == g]) for g in range(4)]
    assert mean == sorted(mean) and np.corrcoef([scored[i] for i in held], [grades[i] for i in held])[0, 1] > 0.9
    assert all(0 <= s <= 3 for s in scored.values())
    kept = {r.doc_id for r in reject_toxic(frame, model).collect()}
    assert reject_toxic(frame, model).columns == frame.columns
    assert all((grades[i] == 0) == (i in kept) for i in held)


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(0)
    eta, y, cuts = rng.normal(size=30), rng.integers(0, 4, 30), np.array([-1.0, 0.2, 1.4])

    def loss(e, c):
        edges = np.concatenate([[-np.inf], c, [np.inf]])
        s = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(s(edges[y + 1] - e) - s(edges[y] - e)).mean()

    by_row, by_cut = _loss_parts(eta, y, cuts)
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-6
        assert abs((loss(eta, cuts + step) - loss(eta, cuts - step)) / 2e-6 - by_cut[i]) < 1e-6
    for i in range(5):
        step = np.zeros(30)
        step[i] = 1e-6
        assert abs((loss(eta + step, cuts) - loss(eta - step, cuts)) / 2e-6 - by_row[i]) < 1e-6


def test_stems_with_many_endings_are_found(spark):
    texts = [prose(i, 40) + (f" grumbla{i} grumble{i * 7}" if i % 2 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = fit_severity(docs(spark, texts), labels)
    found = with_severity(docs(spark, ["grumblexx and grumbleyy", "nothing of it"]), model).orderBy("doc_id").collect()
    assert found[0].severity > 0.5 > found[1].severity


def test_odd_rows_and_missing_labels(spark):
    frame = docs(spark, [None, "", "plain text", "plain text"], ids=[1, 2, None, 3])
    model = SeverityModel([0, 1], [2.0], {"plain": 3.0})
    rows = with_severity(frame, model, chance_col="p").collect()
    assert [round(r.p, 4) for r in rows] == [0.1192, 0.1192, 0.7311, 0.7311]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_severity(frame, none) == SeverityModel([], [])
    assert [r.severity for r in with_severity(frame, SeverityModel([], [])).collect()] == [None] * 4
    one = spark.createDataFrame([(1, 2), (2, 2), (3, None)], "doc_id long, toxic int")
    assert fit_severity(frame.fillna("x", "text"), one).grades == [2]
    assert reject_toxic(frame, SeverityModel([2], [])).count() == 4
    assert with_severity(docs(spark, []), model).collect() == []
    long = docs(spark, ["plain " * 100_000])
    assert with_severity(long, model).first().severity == rows[2].severity


def test_copies_of_one_text_do_not_make_its_words_evidence(spark):
    texts = [prose(i, 40) for i in range(300)] + [prose(999, 40).replace("a", "q")] * 60
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)], "doc_id long, toxic int")
    model = fit_severity(docs(spark, texts), labels)
    assert model.weights == {} and model.grades == [0, 1]
    assert with_severity(docs(spark, ["x"]), model).select(F.col("severity") < 0.5).first()[0]


def test_fit_equals_a_plain_newton_solution():
    rng = np.random.default_rng(5)
    n, k, ridge = 80, 4, 1e-2
    x = (rng.random((n, k)) < 0.4).astype(float)
    y = np.clip(np.floor(x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=n) + 1), 0, 2).astype(int)
    entries, ptr = _stacked([np.flatnonzero(x[:, j]) for j in range(k)])
    w, cuts = _fit(entries, ptr, y, 3, np.zeros(k), ridge, 20_000)

    def slope(p):
        by_row, by_cut = _loss_parts(x @ p[:k], y, p[k:])
        return np.concatenate([x.T @ by_row + ridge * p[:k], by_cut])

    p = np.concatenate([np.zeros(k), [-0.5, 0.5]])
    for _ in range(60):
        bend = np.array([(slope(p + e) - slope(p - e)) / 2e-5 for e in np.eye(k + 2) * 1e-5])
        p = p - np.linalg.solve(bend, slope(p))
    assert np.abs(slope(p)).max() < 1e-9 and np.allclose(np.concatenate([w, cuts]), p, atol=1e-4)


def test_tails_equal_plain_sums():
    n = 30
    for marked in (1, 4, 15, 30):
        found, count = (np.array(v) for v in zip(*[(x, c) for c in (1, 5, 20, 30) for x in range(0, min(c, marked) + 1)]))
        want = [sum(comb(marked, i) * comb(n - marked, c - i) for i in range(x, min(c, marked) + 1) if c - i <= n - marked) / comb(n, c) for x, c in zip(found.tolist(), count.tolist())]
        assert np.allclose(upper_tail(found, count, marked, n), want, rtol=1e-6)


def test_string_ids_several_labels_clashing_names(spark):
    texts = [prose(i, 30) + (" nasty" if i % 2 else "") for i in range(120)]
    frame = spark.createDataFrame([(f"d{i}", t, 1, "keep") for i, t in enumerate(texts)], "doc_id string, text string, _eta int, _severity string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(120)] + [(f"d{i}", 0) for i in range(1, 120, 2)], "doc_id string, toxic int")
    model = fit_severity(frame, labels)
    assert model.weights["nasty"] > 1 and model == fit_severity(frame.repartition(5), labels.repartition(3))
    kept = reject_toxic(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {f"d{i}" for i in range(0, 120, 2)}
    assert {(r._eta, r._severity) for r in kept.collect()} == {(1, "keep")}
