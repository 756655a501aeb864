"""Segment bias of a set of predictions, before and after a segment bonus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import fusion, metrics
from rankloom.operators.joins import attach_labels
from rankloom.sources import sinks

SEGMENTS = ("is_domestic", "is_family")


def prepare(predictions: DataFrame, weights: Mapping[str, float], score: str, log: DataFrame | None = None) -> DataFrame:
    """Predictions with the blend column and the segments."""
    blended = fusion.rebuild_blend(predictions, weights, score)
    return blended if log is None else attach_labels(blended, log)


def bias_audit(df: DataFrame, score: str, boost: float = 0.02, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """Fairness report of the score and of the boosted score in one table."""
    boosted = fusion.segment_boost(df, score, "_boosted", boost=boost)
    before = metrics.fairness_report(boosted, score, segments).withColumn("stage", F.lit("before"))
    after = metrics.fairness_report(boosted, "_boosted", segments).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


def audit_record(df: DataFrame, score: str, path: str | None = None, boost: float = 0.02) -> dict:
    """The audit as a nested record; written as JSON when ``path`` is given."""
    report = [row.asDict() for row in bias_audit(df, score, boost).collect()]  # a few rows
    record = {"score": score, "boost": boost, "report": report, "mixed": metrics.mixed_searches(df, "is_domestic").first().asDict()}
    if path:
        sinks.write_run_record(df.sparkSession, record, path)
    return record


def weighting_comparison(frames: Mapping[str, tuple[DataFrame, str, float]]) -> DataFrame:
    """One row per run ``name -> (predictions, score, query weight)``: overall, segments, ratio."""
    out = None
    for name, (df, score, weight) in frames.items():
        overall = metrics.overall_metrics(df, score)
        segments = metrics.segment_metrics(df, score, ["is_domestic"])
        pick = lambda v, c: F.max(F.when(F.col("value") == v, F.col(c)))
        sides = segments.agg(
            pick("0", "ndcg5").alias("international_ndcg5"), pick("1", "ndcg5").alias("domestic_ndcg5"),
            pick("0", "recall5").alias("international_recall5"), pick("1", "recall5").alias("domestic_recall5"),
            (F.min("ndcg5") / F.max("ndcg5")).alias("domestic_international_epr"),
        )
        row = overall.select(
            F.lit(name).alias("name"), F.lit(float(weight)).alias("international_query_weight"),
            F.col("ndcg5").alias("overall_ndcg5"), F.col("recall5").alias("overall_recall5"),
        ).withColumn("_one", F.lit(1))
        row = row.join(sides.withColumn("_one", F.lit(1)), "_one").drop("_one")
        out = row if out is None else out.unionByName(row)
    return out
