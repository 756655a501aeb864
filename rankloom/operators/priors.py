"""Smoothed target priors, in sample or out of fold.

Every prior is ``(sum of target + m * global) / (count + m)`` over the fit rows
that share a key. Out-of-fold values need no refit: sums are additive, so the
fit without fold f is *total minus fold f*. One aggregation per key set yields
the totals and the k fold parts together (k conditional sums, combined on the
map side), and one join per key set brings them to the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rows import with_window_bucket
from rankloom.operators.joins import hinted, lookup
from rankloom.session import cut_lineage

FOLD = "fold"



def measure(name: str) -> Column:
    """Row value of a measure: ``n``, ``book``, ``click`` or ``click_only``."""
    click, book = F.col("click_bool"), F.col("booking_bool")
    return {
        "n": F.lit(1),
        "book": book,
        "click": click,
        "click_only": F.greatest(click - book, F.lit(0)),
    }[name].cast("double")


@dataclass(frozen=True)
class Rate:
    """One smoothed rate: ``numerator`` per ``denominator``."""

    out: str
    numerator: str
    denominator: str = "n"


@dataclass(frozen=True)
class Block:
    """Rates that share key columns, smoothing strength and fit rows."""

    keys: tuple[str, ...]
    rates: tuple[Rate, ...]
    m: float
    random_only: bool
    count: str | None = None


class SumTable:
    """Sums per key, in total and by fold, and the same sums over all keys.

    The overall sums are an aggregate of the per-key table, which is computed once, so
    the fit rows are read and shuffled once.
    """

    def __init__(
        self, fit: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], n_folds: int | None = None
    ):
        self.keys, self.names, self.n_folds = list(keys), list(measures), n_folds
        parts = [F.sum(value).alias(name) for name, value in measures.items()]
        for name, value in measures.items():
            for f in range(n_folds or 0):
                own = F.when(F.col(FOLD) == f, value).otherwise(0.0)
                parts.append(F.sum(own).alias(f"{name}__f{f}"))
        self.table = cut_lineage(fit.groupBy(*self.keys).agg(*parts))

    def _own(self, name: str, source=F.col) -> Column:
        return F.element_at(F.array(*[source(f"{name}__f{f}") for f in range(self.n_folds)]), F.col(FOLD) + 1)

    def attach(self, df: DataFrame) -> DataFrame:
        """Sums of fit rows sharing the row's key, without the row's own fold; 0 if none."""
        out = df.join(hinted(self.table), self.keys, "left")
        value = lambda n: F.col(n) - self._own(n) if self.n_folds else F.col(n)
        out = out.withColumns({n: F.coalesce(value(n), F.lit(0.0)) for n in self.names})
        extra = [f"{n}__f{f}" for n in self.names for f in range(self.n_folds or 0)]
        return out.drop(*extra)

    def attach_overall(self, df: DataFrame, out: str = "_overall") -> tuple[DataFrame, dict[str, Column]]:
        """The sums over all fit rows (outside the row's fold), read from one struct column."""
        columns = [c for c in self.table.columns if c not in self.keys]
        row = self.table.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("s")).scalar()
        df = df.withColumn(out, row)
        field = lambda c: F.col(out)[c]
        if not self.n_folds:
            return df, {n: field(n) for n in self.names}
        return df, {n: field(n) - self._own(n, field) for n in self.names}


def smoothed_priors(
    df: DataFrame, fit: DataFrame, blocks: Sequence[Block], n_folds: int | None = None
) -> DataFrame:
    """Attach every rate of ``blocks``. With ``n_folds`` both frames carry ``fold``.

    Blocks that share keys share one aggregation and one join.
    """
    if any("booking_window_bucket" in b.keys for b in blocks):
        df, fit = with_window_bucket(df), with_window_bucket(fit)
    by_keys: dict[tuple[str, ...], list[Block]] = {}
    population: dict[bool, dict[str, str]] = {True: {}, False: {}}
    for block in blocks:
        by_keys.setdefault(block.keys, []).append(block)
        for name in {"n"} | {r.numerator for r in block.rates} | {r.denominator for r in block.rates}:
            population[block.random_only][_sum_name(name, block)] = name
    overall: dict[str, Column] = {}
    columns = df.columns
    for i, (keys, group) in enumerate(by_keys.items()):
        random_only = all(b.random_only for b in group)
        rows = fit.where(F.col("random_bool") == 1) if random_only else fit
        # the first table of a population carries all its measures, so that one
        # table serves the overall sums of every block
        wanted = {
            col: name for kind in {b.random_only for b in group} for col, name in population[kind].items()
            if col not in overall or any(col in _sum_names(b) for b in group)
        }
        measures = {}
        for col, name in sorted(wanted.items()):
            value = measure(name)
            if col in population[True] and not random_only:
                value = F.when(F.col("random_bool") == 1, value).otherwise(0.0)
            measures[col] = value
        sums = SumTable(rows, keys, measures, n_folds)
        df = sums.attach(df)
        if any(col not in overall for col in measures):
            df, fresh = sums.attach_overall(df, f"_overall{i}")
            overall |= {col: c for col, c in fresh.items() if col not in overall}
        out: dict[str, Column] = {}
        for block in group:
            for rate in block.rates:
                top, bottom = _sum_name(rate.numerator, block), _sum_name(rate.denominator, block)
                base = overall[bottom] if rate.denominator == "n" else F.greatest(overall[bottom], F.lit(1.0))
                mean = F.coalesce(overall[top] / F.nullif(base, F.lit(0.0)), F.lit(0.0))
                out[rate.out] = (F.col(top) + block.m * mean) / (F.col(bottom) + block.m)
            if block.count:
                out[block.count] = F.col(_sum_name("n", block)).cast("long")
        df = df.withColumns(out).drop(*measures)
        columns = columns + list(out)
    return df.select(*columns)


def _sum_names(block: Block) -> set[str]:
    names = {"n"} | {r.numerator for r in block.rates} | {r.denominator for r in block.rates}
    return {_sum_name(n, block) for n in names}


def _sum_name(name: str, block: Block) -> str:
    return f"_s_{name}_{'random' if block.random_only else 'all'}"


# --- the prior sets ---------------------------------------------------------

HOTEL_RATES = Block(("prop_id",), (Rate("hotel_ctr_unbiased", "click"), Rate("hotel_book_rate_unbiased", "book")), 30, True, "hotel_appearance_count")
DESTINATION_RATE = Block(("srch_destination_id",), (Rate("dest_book_rate", "book"),), 30, True)
DESTINATION_HOTEL = Block(("srch_destination_id", "prop_id"), (Rate("dest_hotel_affinity", "book"),), 30, True)
COUNTRY_PAIR = Block(("visitor_location_country_id", "prop_country_id"), (Rate("country_pair_affinity", "book"), Rate("country_pair_click_rate", "click")), 30, True)
RANDOM_ORDER_SET = (HOTEL_RATES, DESTINATION_RATE, DESTINATION_HOTEL, COUNTRY_PAIR)

HOTEL_CONTEXT_SET = (
    Block(("prop_id", "site_id"), (Rate("hotel_book_rate_by_site", "book"),), 30, True),
    Block(("prop_id", "visitor_location_country_id"), (Rate("hotel_book_rate_by_country", "book"),), 30, True),
    Block(("srch_destination_id", "prop_id"), (Rate("hotel_book_rate_by_dest", "book"),), 30, True),
)

DESTINATION_STAR = Block(
    ("srch_destination_id", "prop_starrating"),
    (Rate("dest_star_book_rate_unbiased", "book"), Rate("dest_star_ctr_unbiased", "click"), Rate("dest_star_click_only_rate_unbiased", "click_only")),
    50, True, "dest_star_count_unbiased",
)
HOTEL_WINDOW = Block(
    ("prop_id", "booking_window_bucket"),
    (Rate("hotel_ctr_by_window_unbiased", "click"), Rate("hotel_book_rate_by_window_unbiased", "book"), Rate("hotel_click_only_rate_by_window_unbiased", "click_only")),
    50, True,
)
TARGET_SET = (DESTINATION_STAR, HOTEL_WINDOW)

HOTEL_ALL_ROWS = Block(
    ("prop_id",),
    (Rate("prop_id_book_rate_oof", "book"), Rate("prop_id_click_rate_oof", "click"), Rate("prop_id_click_only_rate_oof", "click_only")),
    50, False,
)

CLICK_TO_BOOK = Block(("prop_id",), (Rate("click_to_book_rate_oof", "book", "click"),), 50, False)
DESTINATION_WINDOW = Block(("srch_destination_id", "booking_window_bucket"), (Rate("dest_window_book_prior", "book"),), 50, False, "dest_window_book_count")
COUNTRY_PAIR_STAR = Block(
    ("visitor_location_country_id", "prop_country_id", "prop_starrating"),
    (Rate("country_pair_star_book_prior", "book"), Rate("country_pair_star_ctr_prior", "click")),
    50, False, "country_pair_star_count",
)
VELOCITY_SET = (CLICK_TO_BOOK, DESTINATION_WINDOW, COUNTRY_PAIR_STAR)


def random_order_rates(df: DataFrame, fit: DataFrame, n_folds: int | None = None) -> DataFrame:
    """Hotel, destination and country rates from randomly ordered searches."""
    return smoothed_priors(df, fit, RANDOM_ORDER_SET, n_folds)


def hotel_context_rates(df: DataFrame, fit: DataFrame, n_folds: int | None = None) -> DataFrame:
    return smoothed_priors(df, fit, HOTEL_CONTEXT_SET, n_folds)


def oof_pair(
    train: DataFrame, holdout: DataFrame | None, blocks: Sequence[Block], n_folds: int
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold priors for training rows, full-train priors for holdout rows."""
    folds = n_folds if n_folds >= 2 else None
    fitted = smoothed_priors(train, train, blocks, folds)
    return fitted, None if holdout is None else smoothed_priors(holdout, train, blocks)


def hotel_price_stats_oof(train: DataFrame, n_folds: int = 5) -> DataFrame:
    """Mean and spread of a hotel's price over the other folds.

    Prices are centred on the overall mean first, so that the difference of
    square sums keeps its precision.
    """
    centre = F.col("_centre")
    shifted = train.withColumn("_centre", train.agg(F.avg("price_usd")).scalar())
    shifted = shifted.withColumn("_d", F.col("price_usd") - centre)
    d = F.coalesce("_d", F.lit(0.0))
    measures = {"_pn": F.col("_d").isNotNull().cast("double"), "_px": d, "_pxx": d * d}
    sums = SumTable(shifted, ["prop_id"], measures, n_folds)
    out, overall = sums.attach_overall(sums.attach(shifted))
    n, x, xx = F.nullif(F.col("_pn"), F.lit(0.0)), F.col("_px"), F.col("_pxx")
    fallback = overall["_px"] / F.nullif(overall["_pn"], F.lit(0.0))
    variance = F.greatest((xx - x * x / n) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0))
    return out.withColumns({
        "prop_id_price_mean": centre + F.coalesce(x / n, fallback),
        "prop_id_price_std": F.coalesce(F.sqrt(variance), F.lit(0.0)),
    }).withColumn(
        "price_dev_from_prop_mean", F.col("price_usd") - F.col("prop_id_price_mean")
    ).drop("_d", "_centre", "_overall", *measures)


# Child context column of each lattice and its output prefix.
LATTICES = {
    "lattice_prop_dest": "srch_destination_id",
    "lattice_prop_country": "visitor_location_country_id",
    "lattice_prop_stay": "booking_window_bucket",
}


def hierarchical_priors(
    df: DataFrame,
    fit: DataFrame,
    n_folds: int | None = None,
    lattices: Mapping[str, str] = LATTICES,
    parent: str = "prop_id",
    m_child: float = 40,
    m_parent: float = 80,
) -> DataFrame:
    """(parent, context) booking rates shrunk to the parent's own smoothed rate.

    A child key that the fit rows lack gets the overall rate, no lift and no
    reliability. All lattices share one pass over the parent.
    """
    df, fit = with_window_bucket(df), with_window_bucket(fit)
    above = SumTable(fit, [parent], {"_pn": measure("n"), "_pb": measure("book")}, n_folds)
    out, overall = above.attach_overall(above.attach(df))
    mean = F.coalesce(overall["_pb"] / F.nullif(overall["_pn"], F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("_mean", mean)
    mean = F.col("_mean")
    out = out.withColumn("_parent", (F.col("_pb") + m_parent * mean) / (F.col("_pn") + m_parent))
    for prefix, context in lattices.items():
        below = SumTable(fit, [parent, context], {"_cn": measure("n"), "_cb": measure("book")}, n_folds)
        out = below.attach(out)
        n, seen = F.col("_cn"), F.col("_cn") > 0
        rate = (F.col("_cb") + m_child * F.col("_parent")) / (n + m_child)
        out = out.withColumns({
            f"{prefix}_book": F.when(seen, rate).otherwise(mean),
            f"{prefix}_lift": F.when(seen, rate - F.col("_parent")).otherwise(0.0),
            f"{prefix}_reliability": n / (n + m_child),
        }).drop("_cn", "_cb")
    return out.drop("_pn", "_pb", "_parent", "_mean", "_overall")


def lattice_pair(
    train: DataFrame, holdout: DataFrame | None, n_folds: int = 5
) -> tuple[DataFrame, DataFrame | None]:
    folds = n_folds if n_folds >= 2 else None
    fitted = hierarchical_priors(train, train, folds)
    return fitted, None if holdout is None else hierarchical_priors(holdout, train)
