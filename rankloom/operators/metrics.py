"""Ranking quality, segment fairness and agreement of rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rows import relevance
from rankloom.operators.groups import fits_one_task
from rankloom.operators.nulls import null_safe_join
from rankloom.operators.joins import LOOKUP_ROWS, top_k
from rankloom.operators.skew import value_ranks
from rankloom.session import cut_lineage

LABELS = ("booking_bool", "click_bool")


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ideal_dcg(bookings: Column, clicks_only: Column, k: int) -> Column:
    """Best possible DCG@k of a search from its label counts.

    Labels take three values, so the ideal order is bookings, then clicks: two
    running sums of discounts replace a second sort of the search.
    """
    running = [0.0]
    for rank in range(1, k + 1):
        running.append(running[-1] + 1 / math.log2(rank + 1))
    table = F.array(*[F.lit(v) for v in running])
    upto = lambda n: F.element_at(table, F.least(n, F.lit(k)).cast("int") + 1)
    first, both = upto(bookings), upto(bookings + clicks_only)
    return 5 * first + (both - first)


def search_quality(
    df: DataFrame,
    score: str,
    k: int = 5,
    segments: Sequence[str] = (),
    keys: Sequence[str] = ("srch_id",),
) -> DataFrame:
    """One row per search: DCG, ideal DCG, NDCG, hits in the top k, positives, rows.

    Only k rows per search leave the map side for the ranking; the label counts
    are a plain aggregate. ``segments`` adds the value of the search's first hotel.
    """
    rel = relevance(*LABELS)
    narrow = df.select(*keys, "prop_id", score, rel.alias("_rel"))
    top = top_k(narrow, score, k, "_rank", keys).groupBy(*keys).agg(
        F.sum(F.col("_rel") * discount(F.col("_rank"))).alias("dcg"),
        F.sum((F.col("_rel") > 0).cast("long")).alias("hits"),
    )
    booked = F.col("booking_bool").cast("long")
    clicked = F.greatest(F.col("click_bool") - F.col("booking_bool"), F.lit(0)).cast("long")
    counts = df.groupBy(*keys).agg(
        F.sum(booked).alias("_b"),
        F.sum(clicked).alias("_c"),
        F.sum((rel > 0).cast("long")).alias("positives"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.min_by(s, "prop_id").alias(s) for s in segments],
    )
    ideal = ideal_dcg(F.col("_b"), F.col("_c"), k)
    joined = top.join(counts, list(keys)).withColumn("idcg", ideal).drop("_b", "_c")
    return joined.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0))


def ranked_relevance_quality(df: DataFrame, score: str, relevance_col: str, k: int = 5) -> DataFrame:
    """NDCG@k per search for any non-negative relevance column (two top-k passes)."""
    narrow = df.select("srch_id", "prop_id", score, relevance_col)
    gain = F.sum(F.col(relevance_col) * discount(F.col("_rank")))
    got = top_k(narrow, score, k, "_rank").groupBy("srch_id").agg(gain.alias("dcg"))
    best = top_k(narrow, relevance_col, k, "_rank").groupBy("srch_id").agg(gain.alias("idcg"))
    return got.join(best, "srch_id").withColumn(
        "ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    )


def _report_columns(k: int) -> list[Column]:
    recall = F.coalesce(F.sum("hits") / F.nullif(F.sum("positives"), F.lit(0)), F.lit(0.0))
    return [
        F.avg("ndcg").alias(f"ndcg{k}"),
        recall.alias(f"recall{k}"),
        F.count(F.lit(1)).alias("n_searches"),
        F.sum("n_rows").alias("n_rows"),
    ]


def overall_metrics(df: DataFrame, score: str, k: int = 5) -> DataFrame:
    """One row: mean NDCG@k, recall@k, searches, rows."""
    return search_quality(df, score, k).agg(*_report_columns(k))


def mean_ndcg(df: DataFrame, score: str, k: int = 5) -> float:
    return float(search_quality(df, score, k).agg(F.avg("ndcg")).first()[0] or 0.0)


def recall_at_k(df: DataFrame, score: str, k: int = 5) -> DataFrame:
    """Share of relevant rows ranked in the top k, over all searches."""
    return overall_metrics(df, score, k).select(f"recall{k}")


def segment_metrics(df: DataFrame, score: str, segments: Sequence[str], k: int = 5) -> DataFrame:
    """Metrics per value of every segment column, from one ranking pass.

    A search belongs to the segment of its first hotel.
    """
    quality = search_quality(df, score, k, segments)
    pairs = F.array(*[
        F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments
    ])
    measures = ["ndcg", "hits", "positives", "n_rows"]
    return (
        quality.select(F.explode(pairs).alias("_p"), *measures)
        .groupBy(F.col("_p.segment").alias("segment"), F.col("_p.value").alias("value"))
        .agg(*_report_columns(k))
    )


def performance_ratio(segment_table: DataFrame, k: int = 5) -> DataFrame:
    """Lowest over highest segment NDCG per segment column."""
    return segment_table.groupBy("segment").agg(
        (F.min(f"ndcg{k}") / F.max(f"ndcg{k}")).alias("epr")
    )


def fairness_report(df: DataFrame, score: str, segments: Sequence[str], k: int = 5) -> DataFrame:
    """Overall row and segment rows with their ratio, in one table from one pass."""
    quality = search_quality(df, score, k, segments)
    labels = [F.struct(F.lit("overall").alias("segment"), F.lit("all").alias("value"))] + [
        F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments
    ]
    table = (
        quality.select(F.explode(F.array(*labels)).alias("_p"), "ndcg", "hits", "positives", "n_rows")
        .groupBy(F.col("_p.segment").alias("segment"), F.col("_p.value").alias("value"))
        .agg(*_report_columns(k))
    )
    ratio = performance_ratio(table.where(F.col("segment") != "overall"), k)
    return table.join(ratio, "segment", "left")


def mixed_searches(df: DataFrame, segment: str) -> DataFrame:
    """Searches whose rows carry more than one value of ``segment``."""
    per_search = df.groupBy("srch_id").agg(
        (F.min(segment) != F.max(segment)).cast("long").alias("_mixed")
    )
    return per_search.agg(
        F.coalesce(F.sum("_mixed"), F.lit(0)).alias("mixed_count"),
        F.avg(F.coalesce("_mixed", F.lit(0)).cast("double")).alias("mixed_fraction"),
    )


def top_overlap(df: DataFrame, score_a: str, score_b: str, k: int = 5) -> DataFrame:
    """Mean share of the top k that two scores have in common."""
    pair = ["srch_id", "prop_id"]
    a = top_k(df.select(*pair, score_a), score_a, k).select(*pair)
    b = top_k(df.select(*pair, score_b), score_b, k).select(*pair)
    shared = a.join(b, pair).groupBy("srch_id").agg(F.count(F.lit(1)).alias("_both"))
    sizes = df.groupBy("srch_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_size"))
    share = F.coalesce("_both", F.lit(0)) / F.col("_size")
    return sizes.join(shared, "srch_id", "left").agg(F.avg(share).alias(f"top{k}_overlap"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair over the whole table.

    Average ranks come from counted distinct values in a range sort, so a value
    shared by many rows is one row there. Columns of few values are looked up by a broadcast before the
    rows, by then ranks, are shuffled on a column of many.
    """
    out = df.select(*columns)
    small = fits_one_task(out)
    tables = {c: cut_lineage(value_ranks(df.select(c), [], c, small).select(c, F.col("_avg_rank").alias(f"_r_{c}"))) for c in columns}
    few = {c: t.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS for c, t in tables.items()}
    for c in sorted(tables, key=lambda c: not few[c]):
        out = null_safe_join(out, F.broadcast(tables[c]) if few[c] else tables[c], [c], "left").drop(c)
    return correlation_pairs(out, [(a, b, f"_r_{a}", f"_r_{b}") for a in columns for b in columns])


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair, nulls skipped pair by pair."""
    return correlation_pairs(df, [(a, b, a, b) for a in columns for b in columns])


PAIRS_PER_PASS = 64
#: Of a pair: rows, means, and sums of products of the differences from them.
MOMENTS = "i int, n double, x double, y double, xx double, yy double, xy double"


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two parts as those of both; equal means stay as they are."""
    n = a[0] + b[0]
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / n
    return np.array([n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy])


def _moments(batches: Iterator[pa.RecordBatch], pairs: Sequence[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A task's moments of every pair of columns that has rows without a null."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        columns = [(c.fill_null(0.0).to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in batch.columns]
        for i, (j, k) in enumerate(pairs):
            both = columns[j][1] & columns[k][1]
            x, y = columns[j][0][both], columns[k][0][both]
            if not len(x):
                continue
            # differences from the first value: a constant then has no spread at all
            with np.errstate(invalid="ignore"):
                dx, dy = x - x[0], y - y[0]
                mx, my = dx.mean(), dy.mean()
                dx, dy = dx - mx, dy - my
                part = np.array([len(x), x[0] + mx, y[0] + my, dx @ dx, dy @ dy, dx @ dy])
                found[i] = _together(found[i], part) if i in found else part
    kinds = [pa.int32(), *[pa.float64()] * 6]
    columns = list(zip(*[(i, *m) for i, m in found.items()])) or [[]] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["i", "n", "x", "y", "xx", "yy", "xy"])


def _merged(parts: pa.Table) -> pa.Table:
    rows = sorted(zip(*[parts.column(c).to_pylist() for c in parts.column_names[1:]]))
    with np.errstate(invalid="ignore"):
        total = reduce(_together, map(np.array, rows))
    return pa.table([parts.column("i")[:1], *[pa.array([float(v)]) for v in total]], names=parts.column_names)


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """``(column_a, column_b, r)`` rows for ``(name_a, name_b, column_x, column_y)`` pairs.

    Symmetric pairs are computed once. A task folds its batches to one row of moments a pair, which are
    merged pair by pair. A constant column gives null.
    """
    need = sorted({tuple(sorted((x, y))) for _, _, x, y in pairs})
    names: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for a, b, x, y in pairs:
        names.setdefault(tuple(sorted((x, y))), []).append((a, b))
    out = None
    for start in range(0, len(need), PAIRS_PER_PASS):
        batch = need[start:start + PAIRS_PER_PASS]
        columns = sorted({c for pair in batch for c in pair})
        values = df.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(columns)])
        places = [(columns.index(x), columns.index(y)) for x, y in batch]
        moments = values.mapInArrow(partial(_moments, pairs=places), MOMENTS)
        merged = moments.groupBy("i").applyInArrow(_merged, MOMENTS)
        spread = F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
        table = merged.select("i", (F.col("xy") / spread).alias("r"))
        labels = F.element_at(
            F.array(*[
                F.array(*[
                    F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b")) for a, b in names[p]
                ])
                for p in batch
            ]),
            F.col("i") + 1,
        )
        part = table.select(F.explode(labels).alias("_n"), "r").select("_n.*", "r")
        out = part if out is None else out.unionByName(part)
    return out
