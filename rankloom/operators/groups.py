"""Which groups are too large for one task, and how to treat them apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.nulls import null_safe_join
from rankloom.session import cut_lineage

LIMIT_CONF = "spark.rankloom.maxGroupRows"
DEFAULT_LIMIT = 1_000_000

AUTO = "auto"
SEARCH = ("srch_id",)


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def fits_one_task(df: DataFrame, weight: int = 1) -> bool:
    """True when the whole frame, each row counting ``weight`` times, is within the group limit."""
    return df.count() * weight <= group_limit(df)


def oversized_groups(df: DataFrame, keys: Sequence[str] = SEARCH, weight: int = 1) -> DataFrame | None:
    """Keys of the groups above the limit, or ``None`` when there are none.

    At most rows/limit keys can qualify, so the table stays small.
    """
    big = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") * weight > group_limit(df))
        .select(*keys)
    )
    return None if big.isEmpty() else cut_lineage(big)


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Apply ``small`` to normal groups and ``large`` to oversized ones."""
    big = oversized_groups(df, keys) if isinstance(oversized, str) else oversized
    if big is None:
        return small(df)
    key_cols = [k for k in keys if k in big.columns]
    few = F.broadcast(big)  # at most rows/limit keys, so the rows stay where they lie
    low = small(null_safe_join(df, few, key_cols, "left_anti"))
    high = large(null_safe_join(df, few, key_cols, "left_semi"))
    return low.unionByName(high)
