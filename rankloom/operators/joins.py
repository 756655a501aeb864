"""Lookups, semi-joins, unions, sorts, top-k and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.rows import available
from rankloom.operators.relative import score_order
from rankloom.session import cut_lineage

PAIR = ("srch_id", "prop_id")
#: Most rows of a fitted table that is broadcast: some 20 MB of keys and numbers.
LOOKUP_ROWS = 200_000


def duplicate_keys(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    )


def assert_unique(df: DataFrame, keys: Sequence[str] = PAIR) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys {tuple(keys)}")


def broadcast_within(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table``, computed once, with a broadcast hint if it has at most ``rows`` (``LOOKUP_ROWS``) rows.

    A fitted table is an aggregate that is needed anyway. Its columns are keys and numbers, so the
    counted rows bound its bytes. The large side then stays where it is; above the bound both sides shuffle.
    """
    return hinted(cut_lineage(table), rows)


def hinted(fitted: DataFrame, rows: int | None = None) -> DataFrame:
    """A table that is computed already, with the broadcast hint of ``broadcast_within``."""
    most = LOOKUP_ROWS if rows is None else rows
    return F.broadcast(fitted) if fitted.limit(most + 1).count() <= most else fitted


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, Column | float | int] | None = None,
    check: bool = False,
) -> DataFrame:
    """Many-to-one left join with a default for keys that are not in ``table``.

    The table is computed and counted first: within ``LOOKUP_ROWS`` rows it is broadcast, so
    the rows of ``df`` are not shuffled on a key of few values; a larger one is joined by
    a shuffle, in which AQE splits a skewed key on the row side.
    """
    if check:
        assert_unique(table, keys)
    out = df.join(broadcast_within(table), list(keys), "left")
    if defaults:
        out = out.withColumns({
            c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()
        })
    return out


def attach_scores(df: DataFrame, scores: DataFrame, check: bool = True) -> DataFrame:
    """One-to-one left join of model scores on (search, hotel)."""
    if check:
        assert_unique(scores, PAIR)
    return df.join(scores, list(PAIR), "left")


def context_key(df: DataFrame, columns: Sequence[str], fill: int = -1) -> DataFrame:
    """Null context keys become ``fill`` so that they form a group and join."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in columns})


def keep_searches(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose search is listed in ``ids`` (semi-join)."""
    return df.join(ids.select("srch_id"), "srch_id", "left_semi")


def unseen_rate(holdout: DataFrame, train: DataFrame, key: str = "prop_id") -> DataFrame:
    """Share of holdout rows whose key never occurs in the training rows."""
    seen = train.select(key).distinct().withColumn("_seen", F.lit(1))
    flagged = holdout.select(key).join(seen, key, "left")
    return flagged.agg(F.avg(F.col("_seen").isNull().cast("double")).alias("unseen_rate"))


def attach_labels(predictions: DataFrame, log: DataFrame) -> DataFrame:
    """Fill labels and segment inputs of a prediction frame from the log.

    Values already present win; the segments are derived afterwards.
    """
    needed = [
        "click_bool", "booking_bool", "visitor_location_country_id", "prop_country_id", "srch_children_count",
    ]
    raw = log.select(*PAIR, *[F.col(c).alias(f"_raw_{c}") for c in needed])
    have = set(available(needed, predictions))
    out = predictions.join(raw, list(PAIR), "left").withColumns({
        c: F.coalesce(F.col(c), F.col(f"_raw_{c}")) if c in have else F.col(f"_raw_{c}") for c in needed
    }).drop(*[f"_raw_{c}" for c in needed])
    same = F.col("visitor_location_country_id") == F.col("prop_country_id")
    return out.withColumns({
        "is_domestic": F.coalesce(same, F.lit(False)).cast("int"),
        "is_family": F.coalesce(F.col("srch_children_count") > 0, F.lit(False)).cast("int"),
    })


def count_reference(train: DataFrame, test: DataFrame) -> DataFrame:
    """Keys of both logs, the reference for popularity counts."""
    columns = ["prop_id", "srch_destination_id"]
    return train.select(*columns).unionByName(test.select(*columns))


def model_order(df: DataFrame) -> DataFrame:
    """Rows in (search, hotel) order over the cluster; a large search spans partitions."""
    return df.orderBy(*PAIR)


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("srch_id").agg(F.count(F.lit(1)).alias("group_size"))


def top_k(
    df: DataFrame, score: str, k: int, out: str = "rank", keys: Sequence[str] = ("srch_id",)
) -> DataFrame:
    """The k best rows of every search.

    The rank filter sits directly on the window, so Spark keeps only k rows per
    search on the map side; a search of any size costs k rows per input task.
    """
    window = Window.partitionBy(*keys).orderBy(*score_order(score))
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def first_row(df: DataFrame) -> DataFrame:
    """One row per search: its lowest ``prop_id``."""
    window = Window.partitionBy("srch_id").orderBy("prop_id")
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def top_n(df: DataFrame, col: str, n: int, *ties: str) -> DataFrame:
    """The n largest values of a column (each task keeps n rows)."""
    return df.orderBy(F.desc_nulls_last(col), *ties).limit(n)
