"""Exact quantiles of whole columns and of groups of any size.

Columns (``column_quantiles``): one scan gives a mergeable KLL sketch a column, and from it a bracket around each
wanted rank. The next scan counts the values in, between and at the ends of the brackets; the counts tell in which
stretch a rank lies, whatever the sketches said before. Only the values of these stretches are kept, some 200
times less a rank than the column, and each stretch is searched as a column of its own. A sketch that has seen no more values than it
keeps is exact and ends the search. All columns and ranks share the scans, and no value is ever shuffled.

Groups (``exact_quantiles`` with keys): ``percentile`` keeps every distinct value of a group in one aggregation state,
which is right for groups within the row limit. For larger ones a bounded sketch first brackets the wanted order
statistic; values inside the bracket are then counted exactly, all others are only tallied. Brackets are
cut into slices; a running count over the slices finds the one that holds the
wanted rank, and only that slice is put in order. Every step aggregates before
its shuffle. Groups with a rank beside its bracket are done again with wider ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import add, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.groups import by_group_size, fits_one_task, oversized_groups
from rankloom.operators.nulls import null_safe_join
from rankloom.session import cut_lineage, stage_table

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
WIDEN = 8.0
SLICES = 1024
STATE_COST = 10  # a value in an aggregation state weighs as much as this many plain rows
KEPT = 4096  # values that a sketch of a column keeps exactly; some 100 kB when full


@dataclass(frozen=True)
class _Search:
    """Neighbouring ranks among the values of ``col``; ``asked`` tells of which column and rank each of them is."""

    col: int
    ranks: tuple[int, ...]
    asked: tuple[tuple[int, int], ...]


def _rank_error(n: int) -> float:
    """Twice the error of a sketch's ranks at 99 %, as a share of ``n``; none while it holds all its values."""
    return 0.0 if n <= KEPT else 2 * 2.296 / KEPT ** 0.9021


def _number(x: float) -> str:
    return f"double('{x!r}')"


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each known value: the column's number ``_c`` and the value ``_x``."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"struct({i} AS _c, _x{i} AS _x)" for i in range(len(columns)))
    return numbers.selectExpr(f"inline(array({pairs}))").where("_x IS NOT NULL")


def _scan(cells: DataFrame) -> DataFrame:
    """By ``_c``: number ``_n`` and sketch ``_s`` of the values, number ``_a`` of the NaN, computed once.

    Sketches of the tasks merge in two levels, so that no task meets those of all others.
    """
    groups = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cells.withColumn("_task", F.spark_partition_id() % groups).groupBy("_task", "_c").agg(
        F.expr("count_if(isnan(_x)) AS _a"), F.expr("count_if(NOT isnan(_x)) AS _n"),
        F.expr(f"kll_sketch_agg_double(CASE WHEN NOT isnan(_x) THEN _x END, {KEPT}) AS _s"),
    )
    return cut_lineage(parts.groupBy("_c").agg(
        F.expr("sum(_a) AS _a"), F.expr("sum(_n) AS _n"), F.expr(f"kll_merge_agg_double(_s, {KEPT}) AS _s")))


def _zone(cuts: Sequence[float], label: Callable[[int], str], first: int = 0) -> str:
    """Label of the zone of ``_x`` among ascending cuts, by halving: 0 lies below the first cut, 1 is that cut, 2 goes up to the next."""
    if not cuts:
        return label(first)
    half = len(cuts) // 2
    cut, at = _number(cuts[half]), first + 2 * half + 1
    low, high = _zone(cuts[:half], label, first), _zone(cuts[half + 1:], label, at + 1)
    return f"CASE WHEN _x < {cut} THEN {low} WHEN _x = {cut} THEN {label(at)} ELSE {high} END"


def _zoned(cells: DataFrame, bounds: Mapping[int, Sequence[float]], label: Callable[[int, int], str]) -> DataFrame:
    """The numbers that have a label by column and zone, which is ``_z``."""
    trees = [f"WHEN {c} THEN {_zone(cuts, partial(label, c))}" for c, cuts in bounds.items()]
    return cells.where("NOT isnan(_x)").selectExpr("_c", "_x", f"int(CASE _c {' '.join(trees)} END) AS _z").where("_z IS NOT NULL")


def _zone_of(rank: int, sizes: Sequence[int]) -> tuple[int, int]:
    """Zone that holds a rank and the rank inside it."""
    for zone, size in enumerate(sizes):
        if rank < size:
            return zone, rank
        rank -= size
    raise ValueError("rank beyond the column")


def _edges(s: _Search, size: int) -> str:
    """Values around the first and last rank of a search; those values themselves if the sketch is exact."""
    share = lambda rank, sign: min(max((rank + 0.5) / size + sign * _rank_error(size), 0.0), 1.0)
    ends = [f"kll_sketch_get_quantile_double(_s, {_number(share(*end))})" for end in ((s.ranks[0], -1), (s.ranks[-1], 1))]
    return f"max(CASE WHEN _c = {s.col} THEN array({', '.join(ends)}) END)"


def _narrowed(cells: DataFrame, bounds: Mapping[int, Sequence[float]], searches: Sequence[_Search]):
    """The zones that hold wanted ranks as columns of their own: their values, sizes and searches; and the values found."""
    counts = {(r["_c"], r["_z"]): r["count"] for r in _zoned(cells, bounds, lambda c, zone: str(zone)).groupBy("_c", "_z").count().collect()}
    found: dict[tuple[int, int], float] = {}
    number: dict[tuple[int, int], int] = {}
    left = []
    for s in searches:
        cuts = bounds[s.col]
        sizes = [counts.get((s.col, zone), 0) for zone in range(2 * len(cuts) + 1)]
        inside: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for rank, asked in zip(s.ranks, s.asked):
            zone, place = _zone_of(rank, sizes)
            if zone % 2:
                found[asked] = cuts[zone // 2]
            else:
                inside.setdefault(zone, []).append((place, asked))
        for zone, places in inside.items():
            left.append(_Search(number.setdefault((s.col, zone), len(number)), *map(tuple, zip(*places))))
    if not left:
        return None, {}, left, found
    kept = {c: cuts for c, cuts in bounds.items() if any(c == col for col, _ in number)}
    rest = _zoned(cells, kept, lambda c, zone: str(number.get((c, zone), "NULL")))
    return stage_table(rest.selectExpr("_z AS _c", "_x"), "zones"), {i: counts[zone] for zone, i in number.items()}, left, found


def column_quantiles(df: DataFrame, wanted: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float | None]]:
    """``{column: {output: probability}}`` to ``{column: {output: value}}``, exact, with linear interpolation.

    Nulls are skipped, NaN counts as the largest value, a column without values gives None. What comes to the
    driver is a few numbers a column and rank. The frame is read three times; later scans read the values that are left.
    """
    columns = list(wanted)
    if not columns:
        return {}
    values: dict[tuple[int, int], float] = {}
    cells = _cells(df, columns)
    scanned = _scan(cells)
    known = {r["_c"]: (r["_n"], r["_a"]) for r in scanned.select("_c", "_n", "_a").collect()}
    sizes = {c: n for c, (n, _) in known.items()}
    totals = {c: sum(known.get(c, (0, 0))) for c in range(len(columns))}
    searches = []
    for c, column in enumerate(columns):
        for ranks in {_places(float(p), totals[c]) for p in wanted[column].values()}:
            values |= {(c, r): math.nan for r in ranks if r >= sizes[c]}
            left = tuple(r for r in ranks if r < sizes[c])
            searches += [_Search(c, left, tuple((c, r) for r in left))] if left else []
    while searches:
        pairs = scanned.selectExpr(*[f"{_edges(s, sizes[s.col])} AS _e{i}" for i, s in enumerate(searches)]).first()
        waiting, cuts = [], {}
        for s, pair in zip(searches, pairs):
            if sizes[s.col] <= KEPT:
                values |= {s.asked[0]: pair[0], s.asked[-1]: pair[1]}
            else:
                waiting.append(s)
                cuts.setdefault(s.col, set()).update(pair)
        if not waiting:
            break
        cells, sizes, searches, found = _narrowed(cells, {c: sorted(x) for c, x in cuts.items()}, waiting)
        values |= found
        scanned = _scan(cells) if searches else None

    def value(c: int, p: float) -> float | None:
        ranks = _places(p, totals[c])
        if not ranks:
            return None
        low, high = values[c, ranks[0]], values[c, ranks[-1]]
        return low if low == high else low + (high - low) * (p * (totals[c] - 1) - ranks[0])

    return {name: {out: value(c, float(p)) for out, p in wanted[name].items()} for c, name in enumerate(columns)}


def _places(p: float, n: int) -> tuple[int, ...]:
    """0-based ranks around the place of a quantile among ``n`` values."""
    return tuple(sorted({math.floor(p * (n - 1)), math.ceil(p * (n - 1))})) if n else ()


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float], small: bool | None = None
) -> DataFrame:
    """``{output: probability}`` quantiles with linear interpolation, nulls skipped.

    ``small`` tells that the frame is known to be within the group limit; without keys there is one route for all sizes.
    """
    if not keys:
        found = column_quantiles(df, {col: probs})[col]
        return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(n) for n, x in found.items()])
    values = df.select(*keys, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())

    def plain(part: DataFrame) -> DataFrame:
        levels = F.array(*[F.lit(float(p)) for p in probs.values()])
        found = part.groupBy(*keys).agg(F.percentile("_x", levels).alias("_q"))  # one state for all levels
        return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])

    if fits_one_task(values, STATE_COST) if small is None else small:
        return plain(values)
    sliced = lambda part: bracket_quantiles(part, keys, "_x", probs)
    return by_group_size(values, keys, plain, sliced, oversized_groups(values, keys, STATE_COST))


def bracket_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float]) -> DataFrame:
    """The route for large groups: those with a rank beside its bracket are done again with wider brackets.

    The widest brackets hold everything, so the rounds are bounded.
    """
    if not keys:
        return exact_quantiles(df, keys, col, probs)
    values, margin, done = df.select(*keys, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull()), MARGIN, []
    while True:
        found = cut_lineage(_bracketed(values, keys, probs, margin))
        done.append(found.where(~F.col("_missed")).drop("_missed"))
        missed = found.where("_missed").select(*keys)
        if missed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        values, margin = null_safe_join(values, missed, keys, "left_semi"), margin * WIDEN


def _bracketed(values: DataFrame, keys: Sequence[str], probs: Mapping[str, float], margin: float) -> DataFrame:
    """Quantiles of ``_x`` by group, and ``_missed`` where a rank lies beside its bracket.

    Each row falls into one cell of an ordered partition of the value range: a
    slice of a bracket, or the stretch between two brackets. Counts of the cells
    give every rank its cell; only the cells that hold a wanted rank are sorted.
    """
    names = list(probs)
    levels = [float(probs[n]) for n in names]
    bounds = [b for p in levels for b in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch_of = F.percentile_approx("_x", bounds, ACCURACY)
    if margin >= 1:  # everything is inside
        sketch_of = F.array(*[F.min("_x"), F.max("_x")] * len(levels))
    sketch = values.groupBy(*keys).agg(sketch_of.alias("_edges"))
    # a row an oversized group, at most rows/limit of them: the values stay where they lie
    tagged = null_safe_join(values, F.broadcast(sketch), keys, "left")

    x = F.col("_x")
    edges = [F.col("_edges")[i] for i in range(len(bounds))]
    zone = reduce(add, [(e <= x).cast("int") + (e < x).cast("int") for e in edges])
    inside = reduce(or_, [(low <= x) & (x <= high) for low, high in zip(edges[::2], edges[1::2])])
    floor_edge = F.greatest(*[F.when(e <= x, e) for e in edges], F.lit(None))
    ceil_edge = F.least(*[F.when(e >= x, e) for e in edges], F.lit(None))
    part = F.floor((x - floor_edge) / F.nullif(ceil_edge - floor_edge, F.lit(0.0)) * SLICES)
    tagged = tagged.withColumns({
        "_zone": zone,
        "_slice": F.when(inside, F.coalesce(F.least(part, F.lit(SLICES - 1)), F.lit(0))).otherwise(0).cast("int"),
        "_y": F.when(inside, x),
    })
    cell = [*keys, "_zone", "_slice"]
    counted = tagged.groupBy(*cell, "_y").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_zone", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(*cell).agg(F.sum("_c").alias("_size")).withColumns({
        "_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_n": F.sum("_size").over(group),
    })
    places = [F.lit(p) * (F.col("_n") - 1) for p in levels]
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size"))
    wanted = reduce(or_, [holds(F.floor(pos)) | holds(F.ceil(pos)) for pos in places])
    needed = cells.where(wanted).drop("_size")

    within = Window.partitionBy(*cell).orderBy("_y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = null_safe_join(counted, needed, cell, "inner").withColumn(
        "_upto", F.col("_before") + F.sum("_c").over(within)
    )
    first, last, y = F.col("_upto") - F.col("_c"), F.col("_upto") - 1, F.col("_y")

    def value_at(rank):
        """Value at a 0-based rank: in a bracket, or next to one (small groups need that)."""
        return F.max(
            F.when(y.isNotNull() & (first <= rank) & (rank <= last), y)
            .when(y.isNull() & (rank == last), F.col("_max"))
            .when(y.isNull() & (rank == first), F.col("_min"))
        )

    picked = placed.groupBy(*keys).agg(*[
        F.struct(
            value_at(F.floor(pos)).alias("lo"), value_at(F.ceil(pos)).alias("hi"), F.max(pos - F.floor(pos)).alias("w")
        ).alias(f"_p{i}")
        for i, pos in enumerate(places)
    ])

    def value(i: int):
        lo, hi, w = (F.col(f"_p{i}")[f] for f in ("lo", "hi", "w"))
        return lo + (hi - lo) * w

    lost = [F.col(f"_p{i}")[f].isNull() for i in range(len(names)) for f in ("lo", "hi")]
    return picked.select(*keys, *[value(i).alias(n) for i, n in enumerate(names)], reduce(or_, lost).alias("_missed"))
