"""Profiling of a search log: counts, rates, histograms, missingness, position bias."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rows import RATES, window_bucket
from rankloom.functions.snap import snap
from rankloom.operators.nulls import null_safe_join
from rankloom.operators.metrics import correlation_pairs, pearson_matrix
from rankloom.operators.quantiles import column_quantiles
from rankloom.operators.sampling import uniform_rows
from rankloom.session import cut_lineage


def _rate(col: str) -> Column:
    return F.avg(F.col(col).cast("double"))


def rates_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Booking rate, click rate and support by group."""
    return df.groupBy(*keys).agg(
        _rate("booking_bool").alias("booking_rate"),
        _rate("click_bool").alias("click_rate"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``(name, x)`` rows of several numeric columns in one scan."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns
    ])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.name", "_c.x")


def log_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("srch_id").alias("n_searches"),
        F.count_distinct("prop_id").alias("n_hotels"),
        F.count_distinct("srch_destination_id").alias("n_destinations"),
        F.lit(len(df.columns)).alias("n_columns"),
    )


def group_size_histogram(df: DataFrame, clip: int = 50) -> DataFrame:
    sizes = df.groupBy("srch_id").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(F.least("_n", F.lit(clip)).alias("group_size")).agg(
        F.count(F.lit(1)).alias("n_searches")
    )


def group_size_summary(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("srch_id").agg(F.count(F.lit(1)).alias("group_size"))
    return describe(cut_lineage(sizes), ["group_size"])


def label_rates(df: DataFrame) -> DataFrame:
    clicks = F.sum(F.col("click_bool").cast("long"))
    bookings = F.sum(F.col("booking_bool").cast("long"))
    orphan = (F.col("booking_bool") == 1) & (F.col("click_bool") == 0)
    return df.agg(
        _rate("click_bool").alias("click_rate"),
        _rate("booking_bool").alias("booking_rate"),
        (bookings / F.nullif(clicks, F.lit(0))).alias("book_given_click"),
        F.count_if(orphan).alias("bookings_without_click"),
    )


def label_crosstab(df: DataFrame) -> DataFrame:
    """Click by booking counts with both margins."""
    name = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))
    return df.cube("click_bool", "booking_bool").agg(
        name("click_bool").alias("click"), name("booking_bool").alias("booking"),
        F.count(F.lit(1)).alias("n_rows"),
    ).select("click", "booking", "n_rows")


def _labels_per_search(df: DataFrame) -> DataFrame:
    return df.groupBy("srch_id").agg(
        F.sum("click_bool").alias("clicks"), F.sum("booking_bool").alias("bookings")
    )


def label_counts_per_search(df: DataFrame) -> DataFrame:
    """Searches by clipped number of clicks (10) and bookings (5)."""
    pairs = F.array(
        F.struct(F.lit("clicks").alias("label"), F.least("clicks", F.lit(10)).alias("per_search")),
        F.struct(F.lit("bookings").alias("label"), F.least("bookings", F.lit(5)).alias("per_search")),
    )
    return _labels_per_search(df).select(F.explode(pairs).alias("_p")).groupBy(
        F.col("_p.label").alias("label"), F.col("_p.per_search").alias("per_search")
    ).agg(F.count(F.lit(1)).alias("n_searches"))


def empty_search_share(df: DataFrame) -> DataFrame:
    return _labels_per_search(df).agg(
        F.avg((F.col("clicks") == 0).cast("double")).alias("share_without_click"),
        F.avg((F.col("bookings") == 0).cast("double")).alias("share_without_booking"),
    )


def clipped_histogram(df: DataFrame, columns: Sequence[str], bins: int = 80, upper: float = 0.99) -> DataFrame:
    """Equal-width histograms of values clipped at a quantile."""
    ends = column_quantiles(df, {c: {"low": 0.0, "high": upper} for c in columns})

    def slot(c: str) -> Column:
        low, high = (F.lit(ends[c][end]).cast("double") for end in ("low", "high"))
        part = (F.least(F.col(c).cast("double"), high) - low) / F.nullif(high - low, F.lit(0.0))
        return F.least(F.coalesce(F.floor(part * bins), F.lit(0)), F.lit(bins - 1))

    return _placed(df, {c: slot(c) for c in columns}).groupBy("name", "bin").agg(F.count(F.lit(1)).alias("n_rows"))


def _placed(df: DataFrame, places: dict[str, Column], *keep: str) -> DataFrame:
    """``keep`` columns with ``(name, bin)`` of every known value; only bins are spread out, never values."""
    if not places:
        return df.select(*keep, F.lit("").alias("name"), F.lit(None).cast("int").alias("bin")).where(F.lit(False))
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.when(F.col(c).isNotNull(), place).alias("bin")) for c, place in places.items()
    ])
    spread = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.name", "_c.bin")
    return spread.where(F.col("bin").isNotNull())


def null_and_zero_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("name").agg(
        F.avg(F.col("x").isNull().cast("double")).alias("null_share"),
        F.avg(F.coalesce(F.col("x") == 0, F.lit(False)).cast("double")).alias("zero_share"),
    )


def value_counts(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Counts by value, largest first; ``limit`` gives the top of the list."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    ordered = counts.orderBy(F.desc("n_rows"), "value")
    return ordered if limit is None else ordered.limit(limit)


def booked_prices(df: DataFrame, upper: float = 0.99) -> DataFrame:
    """Booked (price, gross) pairs with the quantile cut of each axis."""
    booked = df.where((F.col("booking_bool") == 1) & F.col("price_usd").isNotNull() & F.col("gross_bookings_usd").isNotNull())
    cut = column_quantiles(booked, {c: {"q": upper} for c in ("price_usd", "gross_bookings_usd")})
    level = lambda c: F.lit(cut[c]["q"]).cast("double")
    return booked.select(
        "srch_id", "prop_id", "price_usd", "gross_bookings_usd",
        level("price_usd").alias("price_cut"), level("gross_bookings_usd").alias("gross_cut"),
    )


def supported_rates(df: DataFrame, key: str, support: int = 100) -> DataFrame:
    return rates_by(df, key).where(F.col("n_rows") >= support)


# Labels of the booking-window buckets.
WINDOW_LABELS = ["0", "1", "2-7", "8-14", "15-30", "31-90", "91-365", "365+"]


def window_rates(df: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(v) for v in WINDOW_LABELS]), window_bucket().cast("int") + 1)
    return rates_by(df.withColumn("window", label).where(F.col("window").isNotNull()), "window")


QUANTILE_BIN_COLUMNS = [
    "price_usd", "prop_location_score1", "prop_location_score2", "prop_review_score",
    "srch_booking_window", "orig_destination_distance", "srch_query_affinity_score",
]


def quantile_bin_rates(
    df: DataFrame, columns: Sequence[str] = QUANTILE_BIN_COLUMNS, bins: int = 10, support: int = 0
) -> DataFrame:
    """Booking rate by quantile bin of each column; equal edges merge.

    Columns with fewer than ``support`` known values are left out if asked for.
    """
    known = df.where(F.col("booking_bool").isNotNull()).select("booking_bool", *columns)
    found = column_quantiles(known, {c: {str(i): i / bins for i in range(bins + 1)} for c in columns})
    edges = {c: list(dict.fromkeys(found[c].values())) for c in columns}
    if support:
        counts = known.agg(*[F.count(c).alias(c) for c in columns]).first()
        edges = {c: e for c, e in edges.items() if counts[c] >= support}

    def place(c: str) -> Column:
        x = F.col(c).cast("double")
        return reduce(add, [(x > F.lit(edge)).cast("int") for edge in edges[c][1:-1]], F.lit(0))

    placed = _placed(known, {c: place(c) for c, e in edges.items() if len(e) > 1}, "booking_bool")
    return placed.groupBy("name", "bin").agg(_rate("booking_bool").alias("booking_rate"), F.count(F.lit(1)).alias("n_rows"))


def label_correlates(df: DataFrame, columns: Sequence[str], label: str, top: int | None = 15, absolute: bool = False) -> DataFrame:
    """Correlation of each column with a label, strongest first.

    Columns equal to 6 digits tie and go by name: summation order must not rank them.
    """
    table = correlation_pairs(df, [(c, label, c, label) for c in columns]).where(F.col("r").isNotNull())
    key = snap(F.abs("r") if absolute else F.col("r"), 6)
    ordered = table.select(F.col("column_a").alias("column"), F.col("column_b").alias("label"), "r").orderBy(
        key.desc(), "column"
    )
    return ordered if top is None else ordered.limit(top)


def null_percentages(df: DataFrame, columns: Sequence[str] | None = None, nonzero: bool = True, top: int | None = None) -> DataFrame:
    """Null percentage and count of every column, one aggregate pass."""
    names = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"), (F.col(c) / F.col("_n") * 100).alias("null_pct"))
        for c in names
    ])
    out = row.select(F.explode(cells).alias("_c")).select("_c.*")
    out = out.where(F.col("n_null") > 0) if nonzero else out
    ordered = out.orderBy(F.desc("n_null"), "column")
    return ordered if top is None else ordered.limit(top)


def competitor_sparsity(df: DataFrame) -> DataFrame:
    return null_percentages(df, RATES, nonzero=False)


def missing_pattern(df: DataFrame, columns: Sequence[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """0/1 null flags of a uniform row sample."""
    picked = uniform_rows(df.select("srch_id", "prop_id", *columns), n, seed)
    return picked.select("srch_id", "prop_id", *[F.col(c).isNull().cast("int").alias(c) for c in columns])


def missingness_effect(df: DataFrame) -> DataFrame:
    """Booking rate with and without each informative field, and their ratio."""
    present = {
        "visitor_history": F.col("visitor_hist_starrating").isNotNull(),
        "affinity": F.col("srch_query_affinity_score").isNotNull(),
        "distance": F.col("orig_destination_distance").isNotNull(),
        "any_competitor": F.greatest(*[F.col(c).isNotNull() for c in RATES]),
    }
    book = F.col("booking_bool").cast("double")
    row = df.agg(*[
        F.struct(
            F.avg(F.when(flag, book)).alias("rate_with"), F.avg(F.when(~flag, book)).alias("rate_without")
        ).alias(name)
        for name, flag in present.items()
    ])
    cells = F.array(*[
        F.struct(
            F.lit(n).alias("field"), F.col(n)["rate_with"].alias("rate_with"),
            F.col(n)["rate_without"].alias("rate_without"),
            (F.col(n)["rate_with"] / F.nullif(F.col(n)["rate_without"], F.lit(0.0))).alias("ratio"),
        )
        for n in present
    ])
    return row.select(F.explode(cells).alias("_c")).select("_c.*")


def position_rates(df: DataFrame) -> DataFrame:
    return rates_by(df, "position")


def order_rates(df: DataFrame) -> DataFrame:
    return rates_by(df, "random_bool")


def position_by_order(df: DataFrame) -> DataFrame:
    """Rates by position, normal and random order side by side."""
    sums = df.groupBy("position").pivot("random_bool", [0, 1]).agg(
        _rate("booking_bool").alias("booking_rate"), _rate("click_bool").alias("click_rate")
    )
    return sums.select(
        "position",
        *[F.col(f"{b}_{m}").alias(f"{name}_{m}") for b, name in ((0, "normal"), (1, "random"))
          for m in ("booking_rate", "click_rate")],
    )


def position_bias(df: DataFrame) -> DataFrame:
    """First-slot and overall click rate by order, and the share of each order."""
    first = F.when(F.col("position") == 1, F.col("click_bool").cast("double"))
    table = df.groupBy("random_bool").agg(
        F.avg(first).alias("first_slot_ctr"), _rate("click_bool").alias("overall_ctr"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return table.withColumn("share", F.col("n_rows") / total)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column."""
    values = long_form(df, columns)
    basics = values.groupBy("name").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    found = column_quantiles(df, {c: {"q25": 0.25, "q50": 0.5, "q75": 0.75} for c in columns})
    quartiles = df.sparkSession.createDataFrame(
        [(c, *found[c].values()) for c in columns], "name string, q25 double, q50 double, q75 double")
    return null_safe_join(basics, quartiles, ["name"], "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pearson_matrix(df, columns)
