"""Deterministic sampling, splits and folds.

All draws are hashes of ids, so retries, re-plans and other engines agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_SPACE = 2 ** 32


def id_hash(seed: int | str, *ids: str | Column) -> Column:
    """Unsigned 32-bit hash of ``seed:id[:id...]``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[
        (F.col(i) if isinstance(i, str) else i).cast("string") for i in ids
    ])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_hash(seed: int | str, *ids: str | Column) -> Column:
    """Hash as a number strictly between 0 and 1."""
    return (id_hash(seed, *ids) + F.lit(0.5)) / F.lit(float(HASH_SPACE))


def check_fraction(frac: float) -> None:
    if not 0 < frac <= 1:
        raise ValueError(f"fraction must lie in (0, 1], got {frac}")


def sample_searches(df: DataFrame, frac: float, seed: int = 42) -> DataFrame:
    """Keep ``max(1, int(n * frac))`` whole searches.

    The cut-off is the exact n-th smallest hash. It is found by counting hash
    prefixes, so the ids are never sorted in one place.
    """
    check_fraction(frac)
    ids = df.select("srch_id").distinct().withColumn("_h", id_hash(seed, "srch_id"))
    n_ids = ids.count()
    wanted = max(1, int(n_ids * frac))
    if wanted >= n_ids:
        return df
    prefix, need, chosen = None, wanted, ids
    for shift in (20, 8, 0):  # at most 4096 prefixes come back per step
        part = F.shiftright("_h", shift)
        counts = chosen.groupBy(part.alias("p")).count().orderBy("p").collect()
        for row in counts:
            if need <= row["count"]:
                prefix = row["p"]
                break
            need -= row["count"]
        chosen = chosen.where(part == prefix)
    # ids with hash below the cut-off, plus the first ``need`` ids on it
    tie = chosen.orderBy("srch_id").limit(need).select("srch_id")
    keep = ids.where(F.col("_h") < prefix).select("srch_id").unionByName(tie)
    return df.join(keep, "srch_id", "left_semi")


def held_out(test_size: float = 0.2, seed: int = 42, key: str = "srch_id") -> Column:
    """True for searches of the validation side."""
    return id_hash(seed, key) % 1_000_000 < int(round(test_size * 1_000_000))


def train_validation_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Search-disjoint split as two filters of one scan; no shuffle."""
    side = held_out(test_size, seed)
    return df.where(~side), df.where(side)


def fold_of(n_splits: int = 5, seed: int = 42, key: str = "srch_id") -> Column:
    """Fold number of a search, 0 .. n_splits-1."""
    return (id_hash(f"fold{seed}", key) % n_splits).cast("int")


def usable_splits(df: DataFrame, n_splits: int) -> int:
    """``min(n_splits, number of searches)``; looks at no more than n_splits ids."""
    return df.select("srch_id").distinct().limit(n_splits).count()


def with_folds(df: DataFrame, n_splits: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, fold_of(n_splits, seed))


def drop_negatives(df: DataFrame, drop_frac: float = 0.35, seed: int = 42, placed: bool = False) -> DataFrame:
    """Keep every relevant row and each other row with probability ``1 - drop_frac``.

    A search left empty keeps its row with the lowest ``prop_id``. Whether a
    search is left empty is a two-value aggregate per search, joined back; in rows that are ``placed``
    by search, none of them oversized, a window finds it without a shuffle.
    """
    if drop_frac <= 0:
        return df
    keep = (F.col("click_bool") > 0) | (F.col("booking_bool") > 0) | (
        unit_hash(seed, "srch_id", "prop_id") >= drop_frac
    )
    if placed:
        search = Window.partitionBy("srch_id")
        marked = df.withColumns({"_any": F.max(keep.cast("int")).over(search), "_first": F.min("prop_id").over(search)})
        lowest = F.col("srch_id").isNotNull() & (F.col("_any") == 0) & (F.col("prop_id") == F.col("_first"))
        return marked.where(keep | lowest).select(*df.columns)
    empty = (
        df.groupBy("srch_id")
        .agg(F.max(keep.cast("int")).alias("_any"), F.min("prop_id").alias("_first"))
        .where(F.col("_any") == 0)
        .select("srch_id", "_first")
    )
    return (
        df.join(empty, "srch_id", "left")
        .where(keep | (F.col("prop_id") == F.col("_first")))
        .drop("_first")
        .select(*df.columns)
    )


def uniform_rows(df: DataFrame, n: int = 2000, seed: int = 42, ids: tuple[str, ...] = ("srch_id", "prop_id")) -> DataFrame:
    """``n`` rows drawn uniformly: the smallest hashes (a distributed top-n)."""
    return df.orderBy(id_hash(seed, *ids), *ids).limit(n)


def holdout_size(n_groups: int, test_size: float = 0.2) -> int:
    """Number of groups an exact-size split would hold out."""
    return math.ceil(test_size * n_groups)
