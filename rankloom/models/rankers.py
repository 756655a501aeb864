"""Model recipes: pointwise, pairwise, listwise, sort emulator, stacker, reranker."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import add, eq, ne, or_

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rows import available, feature_columns, finite_or_null, relevance
from rankloom.models.assemble import assemble, target_free
from rankloom.models.boost import SNAPSHOTS, RankModel, feature_table, fit_ranker, held_table
from rankloom.models.ensemble import add_sum
from rankloom.models.objectives import LambdaRank, XeNdcg, YetiRank
from rankloom.operators.fusion import mean_score, rank_scores, score_normalizations, z_scores
from rankloom.operators.joins import attach_scores
from rankloom.operators.metrics import mean_ndcg
from rankloom.operators.ordered import SUFFIX, encode_ids, ordered_target_statistics, target_statistics
from rankloom.operators.relative import first_value, score_order, sort_score_features
from rankloom.operators.sampling import drop_negatives, fold_of
from rankloom.operators.skew import SEARCH, oversized_groups, with_position
from rankloom.session import cut_lineage, scans_in_buckets, stage_table, together

PAIR = ["srch_id", "prop_id"]
XENDCG_SEEDS = (42, 2026, 777, 1337, 9001)


# --- pointwise ---------------------------------------------------------------

@dataclass
class BinaryModel:
    """P(label = 1) from boosted trees, averaged over snapshot lengths."""

    features: list[str]
    model: GBTClassificationModel
    best_round: int

    def predict(self, df: DataFrame, out: str, snapshots: Sequence[float] | None = SNAPSHOTS) -> DataFrame:
        trees, weights = self.model.trees[:self.best_round], self.model.treeWeights[:self.best_round]
        stops = sorted({max(1, int(round(len(trees) * s))) for s in (snapshots or (1.0,))})
        scored = assemble(df, self.features, PAIR).withColumns({f"_m{s}": F.lit(0.0) for s in stops})
        for s in stops:
            scored = add_sum(scored, trees[:s], weights[:s], len(self.features), f"_m{s}")
        chance = reduce(add, [1 / (1 + F.exp(-2 * F.col(f"_m{s}"))) for s in stops]) / len(stops)
        return scored.select(*PAIR, chance.alias(out))


def fit_binary(
    train: DataFrame, validation: DataFrame | None, features: Sequence[str], label: str,
    rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42, patience: int = 150,
) -> BinaryModel:
    """Booking or click model. All rounds are trained; validation rows, when given, choose how many count."""
    def labelled(df: DataFrame) -> DataFrame:
        return assemble(df.withColumn("_label", F.col(label).cast("double")), features, ("_label",))

    learner = GBTClassifier(
        featuresCol="features", labelCol="_label", maxIter=rounds, maxDepth=depth, stepSize=rate,
        maxBins=64, seed=seed, checkpointInterval=5,
    )
    model = learner.fit(labelled(train))
    losses = model.evaluateEachIteration(labelled(validation)) if validation is not None else []
    return BinaryModel(list(features), model, best_length(losses, patience) if losses else len(model.trees))


def best_length(losses: Sequence[float], patience: int) -> int:
    """Rounds up to the least loss that is met before ``patience`` rounds pass without a new least."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


# --- ranking losses ------------------------------------------------------------

def fit_lambdarank(train, validation, features, truncation: int = 30, **options) -> RankModel:
    return fit_ranker(train, features, LambdaRank(truncation), validation=validation, **options)


# Ids that the noisy-ranking model reads as categories.
CATEGORY_IDS = ["prop_id", "srch_destination_id", "site_id", "visitor_location_country_id", "prop_country_id"]


@dataclass
class CategoryRankModel(RankModel):
    """A ranker that reads ids as categories, encoded by the labels of its training rows."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str, snapshots: Sequence[float] | None = SNAPSHOTS) -> DataFrame:
        return super().predict(encode_ids(df, self.tables), out, snapshots)


def fit_yetirank(
    train, validation, features, permutations: int = 3, ids: Sequence[str] = CATEGORY_IDS, **options
) -> CategoryRankModel:
    """Noisy-ranking model. Ids enter as ordered target statistics; raw factor columns are left out."""
    known = available(ids, train)
    label, kept = relevance() / 5, [c for c in feature_columns(features, keep_factors=False) if c not in known]
    tables = target_statistics(train, known, label)
    rows = ordered_target_statistics(train, known, label)
    held = None if validation is None else encode_ids(validation, tables)
    names = [*kept, *[f"{c}{SUFFIX}" for c in known]]
    model = fit_ranker(rows, names, YetiRank(permutations), validation=held, **options)
    return CategoryRankModel(**vars(model), tables=tables)


def fit_xendcg(train, validation, features, seed: int = 42, drop_frac: float = 0.35, **options) -> RankModel:
    table = feature_table(train, features, options.pop("weight", None))
    rows = table.only(drop_negatives(table.rows, drop_frac, seed, placed=table.big is None))
    return fit_ranker(rows, features, XeNdcg(seed), validation=validation, seed=seed, **options)


def xendcg_average(
    train, validation, features, target: DataFrame, seeds: Sequence[int] = XENDCG_SEEDS, out: str = "xendcg_avg_score",
    seed_rounds: Sequence[int] | None = None, drop_frac: float = 0.35, weight: str | None = None, **options
) -> tuple[DataFrame, list[RankModel]]:
    """Mean over seeds of the per-search z scores; ``seed_rounds`` gives each seed its own number of rounds.

    The seeds share one feature table, of which each drops its own negatives.
    """
    table = feature_table(train, features, weight)
    held = None if validation is None else held_table(validation, features)

    def fitted(i: int) -> RankModel:
        own = {**options, "rounds": max(seed_rounds[i], 1)} if seed_rounds else options
        rows = table.only(drop_negatives(table.rows, drop_frac, seeds[i], placed=table.big is None))
        return fit_ranker(rows, features, XeNdcg(seeds[i]), validation=held, seed=seeds[i], **own)

    models = together(target.sparkSession, [partial(fitted, i) for i in range(len(seeds))])
    scored = target.select(*PAIR)
    for seed, model in zip(seeds, models):
        scored = attach_scores(scored, model.predict(target, f"_x{seed}"), check=False)
    names = [f"_x{s}" for s in seeds]
    averaged = mean_score(z_scores(scored, names), [f"{n}_z" for n in names], out)
    return averaged.select(*PAIR, out), models


def international_weight(df: DataFrame, factor: float = 1.7, out: str = "query_weight") -> DataFrame:
    """Weight of a search: ``factor`` when its first hotel is abroad, else 1."""
    tagged = first_value(df, "is_domestic", "_domestic")
    return tagged.withColumn(out, F.when(F.col("_domestic") == 0, float(factor)).otherwise(1.0)).drop("_domestic")


def fit_weighted_xendcg(train, validation, features, factor: float = 1.7, **options) -> RankModel:
    weighted = international_weight(train, factor)
    return fit_xendcg(weighted, validation, features, weight="query_weight", **options)


# --- sort emulator ---------------------------------------------------------------

def _sort_rows(df: DataFrame, features: Sequence[str], n_folds: int) -> DataFrame:
    """Feature vectors, folds and labels of the sort emulator, cached for the fits and scores of all folds."""
    rows = df.withColumns({"fold": fold_of(n_folds), "_label": -F.col("position").cast("double")})
    table = assemble(rows, features, (*PAIR, "fold", "random_bool", "_label")).persist(StorageLevel.MEMORY_AND_DISK)
    table.count()
    return table


def _fit_sort(table: DataFrame, rounds: int, seed: int):
    """Regression of the display position on rows shown in the site's own order."""
    rows = table.where(F.col("random_bool") == 0)
    if rows.isEmpty():
        raise ValueError("no row was shown in the site's own order")
    return GBTRegressor(
        featuresCol="features", labelCol="_label", maxIter=rounds, maxDepth=5, stepSize=0.1, maxBins=64,
        seed=seed, checkpointInterval=5,
    ).fit(rows.select("_label", "features"))


def sort_emulator(
    train: DataFrame, holdout: DataFrame | None, n_folds: int = 5, rounds: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame | None]:
    """Predicted display order from target-free features.

    Training rows are scored by the model of the other folds, holdout rows by a
    model of all training rows.
    """
    features = target_free(feature_columns(train.columns))
    big = oversized_groups(train, SEARCH)
    with scans_in_buckets(train.sparkSession):
        table = _sort_rows(train, features, n_folds)

    def fold_scores(f: int) -> DataFrame:
        model = _fit_sort(table.where(F.col("fold") != f), rounds, seed + f)
        rows = table.where(F.col("fold") == f)
        return model.setPredictionCol("sort_emulator_score").transform(rows).select(*PAIR, "sort_emulator_score")

    try:
        parts = together(train.sparkSession, [partial(fold_scores, f) for f in range(n_folds)])
        scores = stage_table(reduce(lambda a, b: a.unionByName(b), parts), "sort_scores")
        full = None if holdout is None else _fit_sort(table, rounds, seed + 909)
    finally:
        table.unpersist()
    done = sort_score_features(train.join(scores, PAIR, "left"), oversized=big)
    if holdout is None:
        return done, None
    held = full.setPredictionCol("sort_emulator_score").transform(assemble(holdout, features, PAIR))
    held_scores = stage_table(held.select(*PAIR, "sort_emulator_score"), "sort_scores")
    return done, sort_score_features(holdout.join(held_scores, PAIR, "left"), oversized=oversized_groups(holdout, SEARCH))


# --- second stage ------------------------------------------------------------------

# Search-level columns that route the stacker.
ROUTING_TRIMMED = [
    "search_hotel_count", "search_price_cv", "price_usd_rank", "price_z_in_search", "prop_quality_score_rank",
    "quality_rank_minus_price_rank", "is_price_quality_pareto", "value_rank_product", "is_domestic", "is_family",
    "orig_distance_was_missing", "country_pair_star_count",
]
ROUTING_WIDE = ROUTING_TRIMMED + [
    "search_price_std", "search_brand_frac", "search_mean_star", "star_diff_from_search_mean", "search_promo_frac",
    "price_rank_per_star", "price_z_in_tier", "price_vs_tier_median", "is_last_minute", "is_advance_purchase",
    "is_leisure_search", "comp_advantage_rank", "hotel_ctr_vs_dest_avg", "hotel_book_vs_dest_avg",
    "svd_cosine_similarity",
]


def meta_frame(df: DataFrame, scores: Sequence[str], routing: Sequence[str] = ROUTING_TRIMMED) -> tuple[DataFrame, list[str]]:
    """Normalised scores plus routing columns, infinities as null."""
    out = score_normalizations(df, scores)
    features = [f"{c}_{kind}" for c in scores for kind in ("z", "mm", "rank")] + available(routing, df)
    return finite_or_null(out, features), features


@dataclass
class MetaResult:
    scores: DataFrame
    oof_ndcg: float
    fold_scores: list[float]
    model: RankModel
    rounds: int


def fit_meta(
    df: DataFrame, features: Sequence[str], n_folds: int = 10, rounds: int = 20, seed: int = 42, **options
) -> MetaResult:
    """Out-of-fold stacker, and a final fit with the median of the best rounds. All fits share one feature table."""
    table = feature_table(df.withColumn("fold", fold_of(n_folds)), features, options.pop("weight", None), keep=("fold",))
    part = lambda same, f: table.only(table.rows.where(same(F.col("fold"), f)))

    def fold_model(f: int) -> RankModel:
        fit, hold = part(ne, f), part(eq, f)
        return fit_ranker(fit, features, XeNdcg(seed + f), rounds=rounds, validation=hold, seed=seed + f, **options)

    models = together(df.sparkSession, [partial(fold_model, f) for f in range(n_folds)])
    best, fold_scores = [m.best_round for m in models], [max(m.history, default=0.0) for m in models]
    parts = [m.predict(part(eq, f), "meta_oof_score", snapshots=None) for f, m in enumerate(models)]
    scores = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
    final_rounds = int(np.median(best))
    final = fit_ranker(table, features, XeNdcg(seed + 999), rounds=final_rounds, seed=seed + 999, **options)
    oof = mean_ndcg(table.rows.join(scores, PAIR), "meta_oof_score")
    return MetaResult(scores, oof, fold_scores, final, final_rounds)


def top_k_union(df: DataFrame, scores: Sequence[str], k: int = 15) -> DataFrame:
    """Flag rows that any score puts in its search's top k."""
    out = df
    for c in scores:
        out = with_position(out, f"_pos_{c}", score_order(c))
    inside = reduce(or_, [F.col(f"_pos_{c}") <= k for c in scores])
    return out.withColumn("is_candidate", inside.cast("int")).drop(*[f"_pos_{c}" for c in scores])


def candidate_recall(df: DataFrame) -> DataFrame:
    """Candidate rows, all rows, and the share of relevant rows among the candidates."""
    positive = (F.col("booking_bool") > 0) | (F.col("click_bool") > 0)
    return df.agg(
        F.sum("is_candidate").alias("n_candidates"), F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.avg(F.when(positive, F.col("is_candidate").cast("double"))), F.lit(0.0)).alias("positive_recall"),
    )


def fit_reranker(
    df: DataFrame, scores: Sequence[str], fallback: str, k: int = 15, rounds: int = 10, seed: int = 749, **options
) -> tuple[DataFrame, RankModel]:
    """Second-stage ranker on the top-k union.

    Rows outside the union are placed below all candidates of their search, in
    the order of the fallback score.
    """
    flagged = rank_scores(top_k_union(df, scores, k), scores, suffix="_rerank_rank")
    features = [c for s in scores for c in (s, f"{s}_rerank_rank")] + available(ROUTING_WIDE, df)
    flagged = cut_lineage(flagged)
    candidates = flagged.where(F.col("is_candidate") == 1)
    model = fit_ranker(candidates, features, XeNdcg(seed), rounds=rounds, seed=seed, **options)
    scored = flagged.join(model.predict(candidates, "_second", snapshots=None), PAIR, "left")
    first = rank_scores(scored, ["_second"], suffix="_place")
    second = rank_scores(first, [fallback], suffix="_place")
    place = F.when(F.col("is_candidate") == 1, -F.col("_second_place")).otherwise(-1 - F.col(f"{fallback}_place"))
    return second.withColumn("topk_rerank_score", place).drop("_second", "_second_place", f"{fallback}_place"), model
