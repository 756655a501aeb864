"""Severity of toxic text by cumulative-link ordinal regression.

Grades are ordered whole numbers. One weight vector over words is shared by all thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x). The result is the expected severity, the mean
grade under these probabilities. The features x of a text are a set: its lower-case words, and
the word beginnings of 5 or 7 letters that two, or three, of its different words share. Words
that are built on one stem in many forms are found by the latter.

The fit takes at most ``max_rows`` labelled rows, those with the smallest hash of their id, so
its cost does not grow with the corpus. A feature is a candidate if, at one threshold at least, chance alone would
deal it out so unevenly only as often as a normal value lies ``z`` deviations from its mean (exact
hypergeometric tails, so a word of a single toxic text is none). A first pass with a lasso penalty picks
features: the penalty of each is ``z`` standard deviations of the gradient that one as frequent would
have by chance. A second pass fits the picked ones alone with a small ridge penalty. Features whose gradient is then
above their penalty were masked by others: they are taken in and the fit is repeated until none is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import fresh, stage

WORD = re.compile(r"\w+")
STEMS = (5, 7)
MAX_ROWS, MIN_DOCS = 10_000, 5


@dataclass
class SeverityModel:
    """``grades`` in ascending order, one threshold between each two, and word weights."""

    grades: list[int]
    thresholds: list[float]
    weights: dict[str, float] = field(default_factory=dict)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _loss_parts(eta: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean negative log likelihood by eta (per row) and by threshold."""
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    high, low = _sigmoid(edges[y + 1] - eta), _sigmoid(edges[y] - eta)
    chance = np.maximum(high - low, 1e-12)
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, y + 1, -high * (1 - high) / chance)
    np.add.at(by_cut, y, low * (1 - low) / chance)
    return (1 - high - low) / len(y), by_cut[1:-1] / len(y)


def _fit(rows: np.ndarray, ptr: np.ndarray, y: np.ndarray, n_grades: int, penalty: np.ndarray, ridge: float, steps: int):
    """Accelerated proximal gradient with one step size per word, from its bound on the curvature."""
    n, columns = len(y), np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    width = np.bincount(rows, minlength=n).astype(float)
    step = 1.0 / (0.25 * np.bincount(columns, weights=width[rows] + 1, minlength=len(ptr) - 1) / n + ridge + 1e-12)
    share = np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / n
    cuts = np.log(share / (1 - share))
    w = momentum = np.zeros(len(ptr) - 1)
    t = 1.0
    for _ in range(steps):
        eta = np.bincount(rows, weights=momentum[columns], minlength=n)
        by_row, by_cut = _loss_parts(eta, y, cuts)
        grad = np.bincount(columns, weights=by_row[rows], minlength=len(w)) + ridge * momentum
        new = momentum - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / after * (new - w), new, after
        cuts = np.maximum.accumulate(cuts - 2.0 * by_cut)
    return w, cuts


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def upper_tail(found: np.ndarray, count: np.ndarray, marked: int, n: int) -> np.ndarray:
    """P(X >= found) when ``count`` of ``n`` rows are drawn at random and X of the ``marked`` ones are among them."""
    logs, most = _log_factorials(n), np.minimum(count, marked)

    def log_choose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return logs[a] - logs[b] - logs[a - b]

    total, at = np.zeros(len(found)), np.maximum(found, count - (n - marked))
    active = np.flatnonzero(at <= most)
    while len(active):
        c, x = count[active], at[active]
        term = np.exp(log_choose(np.full(len(x), marked), x) + log_choose(np.full(len(x), n - marked), c - x) - log_choose(np.full(len(x), n), c))
        total[active] += term
        at[active] += 1
        # past the mode terms fall ever faster; one far below the sum ends it
        past = (x > c * marked / n) & (term < 1e-9 * total[active])
        active = active[~past & (at[active] <= most[active])]
    return np.minimum(total, 1.0)


def _uneven(lists: list[np.ndarray], y: np.ndarray, n_grades: int, level: float) -> np.ndarray:
    """Which features are dealt out unevenly at a threshold, in either direction."""
    count, n = np.array([len(x) for x in lists], int), len(y)
    at, rows = np.repeat(np.arange(len(lists)), count), np.concatenate(lists)
    chosen = np.zeros(len(lists), bool)
    for k in range(1, n_grades):
        above = np.bincount(at, weights=y[rows] >= k, minlength=len(lists)).astype(np.int64)
        marked = int((y >= k).sum())
        chosen |= (upper_tail(above, count, marked, n) < level) | (upper_tail(count - above, count, n - marked, n) < level)
    return chosen


def features(text: str) -> set[str]:
    """Words of ``text``, and ``stem*n`` for each beginning that n = 2 or 3 different words share."""
    words = set(WORD.findall(text.lower()))
    shared = Counter(w[:n] for n in STEMS for w in words if len(w) > n)
    return words | {f"{stem}*{least}" for stem, count in shared.items() for least in (2, 3) if count >= least}


def _sketch(found: list[str]) -> int:
    """Two min-hashes in one number: copies and near copies mostly agree in it, other texts hardly."""
    codes = [w.encode() for w in found]
    return min((crc32(c) for c in codes), default=0) << 31 ^ min((crc32(c, 7) for c in codes), default=0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grade, text = (batch.column(i).to_pylist() for i in (1, 2))
        found = [sorted(features(t)) for t in text]
        yield pa.RecordBatch.from_pydict({
            "row": batch.column(0), "grade": pa.array(grade, pa.int32()),
            "features": pa.array(found, pa.list_(pa.string())), "sketch": pa.array([_sketch(x) for x in found], pa.int64()),
        })


def fit_severity(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                 max_rows: int = MAX_ROWS, min_docs: int = MIN_DOCS, z: float = 4.0, ridge: float = 1e-4, steps: int = 200) -> SeverityModel:
    """Learn weights and thresholds from the labelled rows of ``docs``.

    Rows with a null grade, id or text are left out. An id with several labels has the highest of them; ids
    may be of any type. Repeated rows and copies with one grade count once, as near copies mostly do. Texts are read
    whole, and features are few beside a text's words. Of ties by hash the smaller id is taken. Other columns are not
    read. With no labelled row the model has no grade and scores null; with a single grade it always
    gives that grade. Only features found in at least ``min_docs`` sampled rows take part.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).dropna().groupBy("id").agg(F.max("grade").alias("grade"))
    picked = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna().join(picked, "id")
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "grade", "text").mapInArrow(_features, f"row {kind}, grade int, features array<string>, sketch long")
    # copies of one text would make all its words look like evidence: one row per grade and sketch is kept
    rows = stage(rows.groupBy("grade", "sketch").agg(F.min_by("features", F.struct("row", "features")).alias("features"), F.min("row").alias("row")), "severity-sample")
    grades_of = rows.select("row", "grade").distinct().toPandas().drop_duplicates("row").sort_values("row")
    grades = sorted(set(grades_of.grade.tolist()))
    if len(grades) < 2:
        return SeverityModel([int(g) for g in grades], [])
    place = {row: i for i, row in enumerate(grades_of.row)}
    y = np.searchsorted(grades, grades_of.grade.to_numpy())
    # the inverted index of a bounded sample: at most max_rows entries a word
    index = rows.select("row", F.explode("features").alias("feature")).groupBy("feature").agg(F.collect_set("row").alias("rows"))
    index = index.filter(F.size("rows") >= min_docs).toPandas().sort_values("feature").reset_index(drop=True)
    names, cuts, w = _select(index.feature.tolist(), [np.fromiter((place[r] for r in sorted(x)), int, len(x)) for x in index["rows"]],
                             y, len(grades), z, ridge, steps)
    return SeverityModel([int(g) for g in grades], cuts.tolist(), dict(zip(names, w.tolist())))


def _stacked(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*lists, np.zeros(0, int)]).astype(int), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(int)


def _select(names: list[str], lists: list[np.ndarray], y: np.ndarray, n_grades: int, z: float, ridge: float,
            steps: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, thresholds, weights) of the features that carry evidence; ``lists`` has the rows of each feature."""
    fair = _uneven(lists, y, n_grades, NormalDist().cdf(-z)) if lists else np.zeros(0, bool)
    names, lists = [x for x, ok in zip(names, fair) if ok], [x for x, ok in zip(lists, fair) if ok]
    n, count = len(y), np.array([len(x) for x in lists], int)
    alone = np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / n
    by_row, _ = _loss_parts(np.zeros(n), y, np.log(alone / (1 - alone)))
    penalty = z * np.std(by_row) * np.sqrt(count)
    entries, ptr = _stacked(lists)
    w, _ = _fit(entries, ptr, y, n_grades, penalty, 0.0, steps)
    chosen = np.flatnonzero(w)
    while True:
        own, own_ptr = _stacked([lists[i] for i in chosen])
        w, cuts = _fit(own, own_ptr, y, n_grades, np.zeros(len(chosen)), ridge, 5 * steps)
        eta = np.bincount(own, weights=np.repeat(w, np.diff(own_ptr)), minlength=n)
        pull = np.abs(np.bincount(np.repeat(np.arange(len(lists)), count), weights=_loss_parts(eta, y, cuts)[0][entries], minlength=len(lists)))
        masked = np.setdiff1d(np.flatnonzero(pull > penalty), chosen)
        if not len(masked):
            return [names[i] for i in chosen], cuts, w
        chosen = np.sort(np.concatenate([chosen, masked]))


def linear_score(text: Column, model: SeverityModel) -> Column:
    """w.x of each text: the summed weights of the features it has, each counted once."""
    weights = model.weights
    words = {f for f in weights if "*" not in f}
    stems = {f.split("*")[0] for f in weights if "*" in f}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        result = np.zeros(len(texts))
        for i, text in enumerate(texts):
            own = set(WORD.findall(text.lower())) if text else set()
            found = own & words
            if stems:
                shared = Counter(w[:n] for n in STEMS for w in own if w[:n] in stems and len(w) > n)
                found |= {f"{stem}*{least}" for stem, count in shared.items() for least in (2, 3) if count >= least}
            result[i] = sum(weights.get(f, 0.0) for f in sorted(found))
        return pd.Series(result)

    return score(text)


def with_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text", severity_col: str = "severity",
                  chance_col: str | None = None) -> DataFrame:
    """``docs`` with the expected severity, and with P(above the lowest grade) if asked for.

    A null or empty text has no feature and gets the severity of the thresholds alone.
    Without any grade both results are null. Repeated rows score alike; very long texts are read
    whole; columns of ``docs`` stay, except that one named like a result is replaced.
    """
    linear = fresh(docs, "_eta")
    grades, eta = model.grades, F.col(linear)
    above = [1.0 / (1.0 + F.exp(F.lit(float(c)) - eta)) for c in model.thresholds]  # P(grade > k)
    severity = F.lit(float(grades[0])) if grades else F.lit(None).cast("double")
    for low, high, chance in zip(grades, grades[1:], above):
        severity = severity + float(high - low) * chance
    out = docs.withColumn(linear, linear_score(F.col(text_col), model)).withColumn(severity_col, severity)
    if chance_col:
        out = out.withColumn(chance_col, above[0] if above else F.lit(0.0 if grades else None).cast("double"))
    return out.drop(linear)


def reject_toxic(docs: DataFrame, model: SeverityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose expected severity lies at least ``threshold`` above the lowest grade."""
    if len(model.grades) < 2:
        return docs
    severity = fresh(docs, "_severity")
    scored = with_severity(docs, model, text_col, severity)
    return scored.filter(F.col(severity) - model.grades[0] < threshold).drop(severity)
