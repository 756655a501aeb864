"""Score normalisation and fusion inside each search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.relative import resolve_oversized, score_order
from rankloom.operators.skew import AUTO, with_group_stats, with_position


def z_scores(df: DataFrame, columns: Sequence[str], oversized=AUTO, suffix: str = "_z") -> DataFrame:
    """``(x - mean) / std`` per search; a zero or missing std counts as 1."""
    stats = {}
    for c in columns:
        stats |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = with_group_stats(df, stats, oversized=oversized)
    return out.withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    }).drop(*stats)


def minmax_scores(df: DataFrame, columns: Sequence[str], oversized=AUTO) -> DataFrame:
    """``(x - min) / (max - min)`` per search; a zero range counts as 1."""
    stats = {}
    for c in columns:
        stats |= {f"_lo_{c}": F.min(c), f"_hi_{c}": F.max(c)}
    out = with_group_stats(df, stats, oversized=oversized)
    return out.withColumns({
        f"{c}_mm": (F.col(c) - F.col(f"_lo_{c}"))
        / F.coalesce(F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0)), F.lit(1))
        for c in columns
    }).drop(*stats)


def rank_scores(df: DataFrame, columns: Sequence[str], oversized=AUTO, suffix: str = "_rank") -> DataFrame:
    """Position of each score in its search over the search size; best is lowest."""
    big = resolve_oversized(df, oversized)
    out = with_group_stats(df, {"_size": F.count(F.lit(1))}, oversized=big)
    for c in columns:
        out = with_position(out, f"_pos_{c}", score_order(c), oversized=big)
    return out.withColumns({f"{c}{suffix}": F.col(f"_pos_{c}") / F.col("_size") for c in columns}).drop(
        "_size", *[f"_pos_{c}" for c in columns]
    )


def score_normalizations(df: DataFrame, columns: Sequence[str], oversized=AUTO) -> DataFrame:
    """z, min-max and rank versions of every score."""
    big = resolve_oversized(df, oversized)
    return rank_scores(minmax_scores(z_scores(df, columns, big), columns, big), columns, big)


def reciprocal_rank_fusion(
    df: DataFrame, columns: Sequence[str], k: int = 60, out: str = "rrf_score", oversized=AUTO
) -> DataFrame:
    """Sum of ``1 / (k + rank)`` over the scores."""
    big = resolve_oversized(df, oversized)
    ranked = df
    for c in columns:
        ranked = with_position(ranked, f"_pos_{c}", score_order(c), oversized=big)
    total = reduce(add, [1 / (k + F.col(f"_pos_{c}")) for c in columns])
    return ranked.withColumn(out, total).drop(*[f"_pos_{c}" for c in columns])


def linear(weights: Mapping[str, float]) -> Column:
    return reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def weighted_blend(df: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    return df.withColumn(out, linear(weights))


def rebuild_blend(
    df: DataFrame, weights: Mapping[str, float], out: str = "signed_z_blend", oversized=AUTO
) -> DataFrame:
    """Blend of per-search z scores; base scores are normalised where needed."""
    if out in df.columns:
        return df
    missing = [c for c in weights if c not in df.columns]
    if missing:
        raise ValueError(f"score columns missing for {out}: {missing}")
    todo = [c for c in weights if f"{c}_z" not in df.columns]
    df = z_scores(df, todo, oversized) if todo else df
    return weighted_blend(df, {f"{c}_z": w for c, w in weights.items()}, out)


def segment_blend(
    df: DataFrame,
    segment: str,
    segment_weights: Mapping[str, Mapping[str, float]],
    default: Mapping[str, float],
    out: str = "segment_signed_z_blend",
) -> DataFrame:
    """Blend with the weights of the row's segment, or the default weights."""
    if segment not in df.columns:
        return weighted_blend(df, default, out)
    label, chosen = F.col(segment).cast("string"), None
    for value, weights in segment_weights.items():
        hit, score = label == str(value), linear(weights)
        chosen = F.when(hit, score) if chosen is None else chosen.when(hit, score)
    return df.withColumn(out, linear(default) if chosen is None else chosen.otherwise(linear(default)))


def residual_blend(
    df: DataFrame, base: str, meta: str, alpha: float | Column, out: str = "residual_meta_score",
    clip: float = 3.0, oversized=AUTO,
) -> DataFrame:
    """Base z score moved by ``alpha`` times the clipped z difference to ``meta``."""
    scored = z_scores(df, [base, meta], oversized, suffix="__zz")
    base_z = F.col(f"{base}__zz")
    gap = F.greatest(F.least(F.col(f"{meta}__zz") - base_z, F.lit(clip)), F.lit(-clip))
    step = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return scored.withColumn(out, base_z + step * gap).drop(f"{base}__zz", f"{meta}__zz")


def segment_boost(
    df: DataFrame, score: str, out: str, segment: str = "is_domestic", value: int = 0, boost: float = 0.02
) -> DataFrame:
    """Constant bonus for the rows of one segment."""
    bonus = F.when(F.col(segment) == value, F.lit(float(boost))).otherwise(0.0)
    return df.withColumn(out, F.col(score) + bonus)


def mean_score(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Null-skipping mean of several columns."""
    total = reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    known = reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])
    return df.withColumn(out, total / F.nullif(known, F.lit(0)))
