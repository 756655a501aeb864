"""Work inside groups of any size.

A search normally holds a few dozen rows, so a window over ``srch_id`` is the
right plan. One group may, however, hold a large share of the whole log, and a
window would then sort that group in one task. Every group-relative operator
here has two exact routes:

* groups up to ``spark.rankloom.maxGroupRows`` rows: plain windows, one shuffle;
* larger groups: statistics by ``groupBy`` (partial aggregation) joined back,
  and order-based values from a range sort that cuts the group into chunks,
  with per-chunk totals carried forward.

The two parts are unioned. When no group is over the limit, only the window
plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.groups import AUTO, SEARCH, by_group_size, group_limit, oversized_groups  # noqa: F401
from rankloom.operators.nulls import null_safe_join
from rankloom.operators.quantiles import bracket_quantiles
from rankloom.session import cut_lineage

# --- plain statistics -------------------------------------------------------

def with_group_stats(
    df: DataFrame,
    stats: Mapping[str, Column],
    keys: Sequence[str] = SEARCH,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Attach aggregate expressions evaluated over each row's group."""
    def small(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys)
        return part.withColumns({name: expr.over(window) for name, expr in stats.items()})

    def large(part: DataFrame) -> DataFrame:
        table = part.groupBy(*keys).agg(*[expr.alias(name) for name, expr in stats.items()])
        return null_safe_join(part, table, keys, "left")

    return by_group_size(df, keys, small, large, oversized)


def with_group_median(
    df: DataFrame,
    medians: Mapping[str, str],
    keys: Sequence[str] = SEARCH,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Attach exact medians: ``{output: column}``."""
    def small(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys)
        return part.withColumns({out: F.median(col).over(window) for out, col in medians.items()})

    def large(part: DataFrame) -> DataFrame:
        for out, col in medians.items():
            part = null_safe_join(part, bracket_quantiles(part, keys, col, {out: 0.5}), keys, "left")
        return part

    return by_group_size(df, keys, small, large, oversized)


# --- order-based values -----------------------------------------------------

#: Rows of one stretch of an oversized group, where a hash cuts it.
STRETCH_ROWS = 200_000

def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort by (keys, order) over the cluster and number rows inside each chunk.

    ``_seq`` ascends in sort order, ``_chunk`` is the range partition. The result
    is checkpointed so that every later use sees the same chunk borders.
    """
    ordered = df.sort(*keys, *order).withColumn("_seq", F.monotonically_increasing_id())
    return cut_lineage(ordered.withColumn("_chunk", F.shiftright("_seq", 33)))


def _carry(chunks: DataFrame, keys: Sequence[str], total: Column, carry: Callable[[Column], Column]) -> DataFrame:
    """Per (group, chunk): first ``_seq`` and the running value of earlier chunks."""
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunks.groupBy(*keys, "_chunk")
        .agg(total.alias("_total"), F.min("_seq").alias("_first"))
        .withColumn("_carry", carry(F.col("_total")).over(earlier))
        .drop("_total")
    )


def with_position(
    df: DataFrame,
    out: str,
    order: Sequence[Column],
    keys: Sequence[str] = SEARCH,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """1-based position in each group by ``order``, which must be a total order."""
    def small(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))

    def large(part: DataFrame) -> DataFrame:
        chunks = range_chunks(part, keys, order)
        borders = _carry(chunks, keys, F.count(F.lit(1)), F.sum)
        joined = null_safe_join(chunks, borders, [*keys, "_chunk"], "left")
        position = F.col("_seq") - F.col("_first") + 1 + F.coalesce("_carry", F.lit(0))
        return joined.withColumn(out, position.cast("long")).drop("_seq", "_chunk", "_first", "_carry")

    return by_group_size(df, keys, small, large, oversized)


def with_running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str],
    order: Sequence[Column | str],
    even: Column,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Attach sums over the rows of the group that come before a row in ``order``, which must be total; 0 at first.

    ``even`` is a number from 0 up to, but not, 1 that ascends with ``order`` and is spread evenly, as a hash is. It cuts an oversized
    group into stretches of some ``STRETCH_ROWS`` rows without a sort over the cluster; their totals, a few
    rows a group, are carried forward. All groups share one shuffle.
    """
    big = oversized_groups(df, keys) if isinstance(oversized, str) else oversized
    if big is None:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out: F.coalesce(F.sum(x).over(earlier), F.lit(0.0)) for out, x in sums.items()})
    values = {out: f"_v{i}" for i, out in enumerate(sums)}
    sizes = null_safe_join(df.select(*keys), F.broadcast(big), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = min(STRETCH_ROWS, group_limit(df))
    cuts = cut_lineage(sizes.select(*keys, F.ceil(F.col("_n") / rows).alias("_cuts")))
    cut = null_safe_join(df, F.broadcast(cuts), keys, "left").withColumns({
        **{values[out]: x for out, x in sums.items()},
        "_chunk": F.coalesce(F.floor(even * F.col("_cuts")), F.lit(0)).cast("long"),
    })
    totals = cut.where(F.col("_cuts").isNotNull()).groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(v) for v in values.values()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *[F.sum(v).over(before).alias(f"{v}_carry") for v in values.values()])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = null_safe_join(cut.withColumns({out: F.sum(v).over(inside) for out, v in values.items()}), F.broadcast(carried), [*keys, "_chunk"], "left")
    zero = F.lit(0.0)
    return done.withColumns({out: F.coalesce(out, zero) + F.coalesce(f"{v}_carry", zero) for out, v in values.items()}).drop(
        "_cuts", "_chunk", *values.values(), *[f"{v}_carry" for v in values.values()])


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, small: bool = False) -> DataFrame:
    """Average rank of each distinct value in its group: ``keys, col, _avg_rank, _n``.

    Equal values are counted first, so copies of one value never travel twice.
    ``small`` tells that no group exceeds the limit; then no range sort is needed.
    """
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, col)
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    if small:
        whole = Window.partitionBy(*keys)
        upto = F.sum("_ties").over(whole.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
        average = upto - F.col("_ties") + (F.col("_ties") + 1) / 2
        return counts.select(*keys, col, average.alias("_avg_rank"), F.sum("_ties").over(whole).alias("_n"))
    chunks = range_chunks(counts, keys, [F.col(col)])
    borders = _carry(chunks, keys, F.sum("_ties"), F.sum)
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = counts.groupBy(*keys).agg(F.sum("_ties").alias("_n"))
    upto = F.sum("_ties").over(inside)
    ranked = null_safe_join(chunks.withColumn("_upto", upto), borders, [*keys, "_chunk"], "left")
    ranked = null_safe_join(ranked, totals, keys, "left") if keys else ranked.withColumn(
        "_n", totals.scalar()
    )
    below = F.col("_upto") - F.col("_ties") + F.coalesce("_carry", F.lit(0))
    return ranked.select(*keys, col, (below + (F.col("_ties") + 1) / 2).alias("_avg_rank"), "_n")


def with_percent_rank(
    df: DataFrame,
    ranks: Mapping[str, str],
    keys: Sequence[str] = SEARCH,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Attach ``average rank / count`` of each value in its group; nulls stay null."""
    def small(part: DataFrame) -> DataFrame:
        outputs = {}
        for out, col in ranks.items():
            ordered = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(col))
            upto = F.count(col).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            known = F.count(col).over(Window.partitionBy(*keys))
            average = (F.rank().over(ordered) + upto) / 2
            outputs[out] = F.when(F.col(col).isNotNull(), average / known)
        return part.withColumns(outputs)

    def large(part: DataFrame) -> DataFrame:
        for out, col in ranks.items():
            table = value_ranks(part, keys, col)
            part = null_safe_join(part, table, [*keys, col], "left")
            part = part.withColumn(out, F.col("_avg_rank") / F.col("_n")).drop("_avg_rank", "_n")
        return part

    return by_group_size(df, keys, small, large, oversized)


def with_pareto_flag(
    df: DataFrame,
    out: str,
    cost: str,
    gain: str,
    keys: Sequence[str] = SEARCH,
    oversized: DataFrame | None | str = AUTO,
) -> DataFrame:
    """1 when no cheaper (or equally cheap) row has a higher gain.

    A null cost counts as +inf and a null gain as -inf.
    """
    cost_of = F.coalesce(F.col(cost), F.lit(float("inf")))
    gain_of = F.coalesce(F.col(gain), F.lit(float("-inf")))

    def small(part: DataFrame) -> DataFrame:
        earlier = (
            Window.partitionBy(*keys)
            .orderBy(cost_of.asc(), gain_of.desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        best = F.coalesce(F.max(gain_of).over(earlier), F.lit(float("-inf")))
        return part.withColumn(out, (gain_of >= best).cast("int"))

    def large(part: DataFrame) -> DataFrame:
        part = part.withColumns({"_cost": cost_of, "_gain": gain_of})
        ladder = part.groupBy(*keys, "_cost").agg(F.max("_gain").alias("_top"))
        chunks = range_chunks(ladder, keys, [F.col("_cost")])
        borders = _carry(chunks, keys, F.max("_top"), F.max)
        inside = (
            Window.partitionBy(*keys, "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
        )
        steps = null_safe_join(
            chunks.withColumn("_before", F.max("_top").over(inside)), borders, [*keys, "_chunk"], "left"
        ).select(
            *keys, "_cost", "_top",
            F.coalesce(F.greatest("_before", "_carry"), F.lit(float("-inf"))).alias("_best"),
        )
        joined = null_safe_join(part, steps, [*keys, "_cost"], "left")
        flag = (F.col("_gain") == F.col("_top")) & (F.col("_gain") >= F.col("_best"))
        return joined.withColumn(out, flag.cast("int")).drop("_cost", "_gain", "_top", "_best")

    return by_group_size(df, keys, small, large, oversized)
