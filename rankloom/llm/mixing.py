"""Mixing of sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i, how often it is taken. Among all rates with
sum(r_i * size_i) = target_s and 0 <= r_i <= limit, those that stay closest to 1 in relative entropy are
r_i = min(limit, exp(lambda_s * x_i)), x_i = size_i / mean size of the source. The multipliers lambda solve
the convex dual sum(phi(lambda_s * x_i)) - lambda_s * target_s / mean_s, phi' = min(limit, exp).

1. One scan counts words. The rate depends on source and size alone, so all later work on rates runs over
   counts per (source, size), not over documents: copies and a hot source are summed before any shuffle.
2. Newton steps for all sources at once: a step is one grouped sum of gradient and curvature, with a
   bracket that halves where Newton leaves it. The multipliers stay in a staged table.
3. Rates become whole copies: within a source the classes go from long to short texts, each takes the
   whole number of copies next to its share, and what rounding leaves is carried to the next.
4. Of the documents of a class, those with the smallest hash of their id get the odd copy. Classes with
   very many documents are ranked in slices of the hash, of which only narrow rows are moved.

Sums are exact decimals, so neither partitions nor the order of tasks change a result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import broadcast_if_small, fresh, stage, text_or_empty

LIMIT, CYCLE = 3, (1, 2, 3)
#: Newton steps; the bracket has then been halved often enough for any double.
STEPS, CLOSE = 80, 1e-10
#: Documents of one class that are ranked in one task.
SLICE = 50_000


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their position by code point, null last, from a range sort over the cluster."""
    order = sources.sort(F.col("source").isNull(), "source").withColumn("seq", F.monotonically_increasing_id())
    order = stage(order.withColumn("part", F.shiftright("seq", 33)), "mix-sources")
    parts = order.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    parts = parts.select("part", "first", before.alias("before"))
    return order.join(F.broadcast(parts), "part").select("source", "words", "docs", (F.col("seq") - F.col("first") + F.col("before")).alias("sid"))


def with_targets(sources: DataFrame, limit: int = LIMIT, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(sid, source, words, docs, target): shares by weight, none above ``limit`` times its words."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("sid") % len(cycle) + 1).cast("int"))
    weighed = stage(_numbered(sources).withColumn("weight", weight), "mix-weights")
    total, weights = weighed.agg(F.sum("words"), F.sum("weight")).first()
    unit, full = (total or 0) / (weights or 1), -1
    while True:
        over = F.col("weight") * unit > F.col("words") * limit
        held, n, free = weighed.agg(F.sum(F.when(over, F.col("words") * limit)), F.count(F.when(over, 1)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not free:
            break
        full, unit = n, (total - (held or 0)) / free
    target = F.least(F.col("weight") * unit, (F.col("words") * limit).cast("double"))
    return stage(weighed.select("sid", "source", "words", "docs", target.alias("target")), "mix-targets")


def _exact(value: Column) -> Column:
    """Decimals add up to the same sum in any order."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def _rate(limit: int) -> Column:
    return F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(math.log(limit))))


def solve_tilts(counts: DataFrame, targets: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """(sid, mean, target, tilt) of every source with words; ``counts`` has (sid, size, n)."""
    start = targets.filter("words > 0").select(
        "sid", "target", (F.col("words") / F.col("docs")).alias("mean"), F.log(F.col("target") / F.col("words")).alias("tilt"),
        F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"),
        (F.col("target") >= F.col("words") * limit).alias("done"))
    # a source that gives all it may has no finite multiplier: every document is at the limit
    state = stage(start.withColumn("tilt", F.when(F.col("done"), F.lit(math.inf)).otherwise(F.col("tilt"))), "mix-tilts")
    for _ in range(steps):
        work = counts.join(broadcast_if_small(state.filter("not done").select("sid", "mean", "tilt")), "sid")
        work = work.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _rate(limit))
        inner = F.col("tilt") * F.col("x") < math.log(limit)
        sums = work.groupBy("sid").agg(
            _exact(F.col("n") * F.col("x") * F.col("rate")).alias("taken"),
            _exact(F.when(inner, F.col("n") * F.col("x") * F.col("x") * F.col("rate")).otherwise(0.0)).alias("bend"))
        step = state.join(sums, "sid", "left").withColumn("gap", F.col("taken") - F.col("target") / F.col("mean"))
        step = step.withColumns({
            "low": F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))})
        reach = 1.0 + F.abs("tilt")
        wide = F.when(F.col("high") == math.inf, F.col("tilt") + reach).when(F.col("low") == -math.inf, F.col("tilt") - reach)
        newton = F.col("tilt") - F.col("gap") / F.when(F.col("bend") > 0, F.col("bend"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        after = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(F.coalesce(wide, (F.col("low") + F.col("high")) / 2))
        near = F.abs("gap") <= CLOSE * F.col("target") / F.col("mean")
        state = stage(step.select(
            "sid", "target", "mean", F.when(F.col("done") | near, F.col("tilt")).otherwise(after).alias("tilt"), "low", "high",
            (F.col("done") | near | (after == F.col("tilt"))).alias("done")), "mix-tilts")
        if state.filter("not done").isEmpty():
            break
    return state.select("sid", "mean", "target", "tilt")


def whole_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, limit: int) -> np.ndarray:
    """Copies per class, classes in descending order of size; what one class is off is carried to the next."""
    share = n * rate * size
    off, out = target - float(math.fsum(share.tolist())), []
    for s, most, want in zip(size.tolist(), (n * limit).tolist(), share.tolist()):
        copies = min(max(int((want + off) / s + 0.5), 0), most)
        off += want - copies * s
        out.append(copies)
    return np.array(out, np.int64)


def _classes(counts: DataFrame, tilts: DataFrame, limit: int) -> DataFrame:
    """(sid, size, n, rate, base, extra): all documents of a class get ``base`` copies, ``extra`` of them one more.

    A task holds the sizes of one source: fewer than the square root of twice its words.
    """
    rated = counts.join(broadcast_if_small(tilts), "sid").withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _rate(limit))

    def copies(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        found = whole_copies(rows["size"].to_numpy(), rows["n"].to_numpy(), rows["rate"].to_numpy(), float(rows["target"].iloc[0]), limit)
        n = rows["n"].to_numpy()
        return pd.DataFrame({"sid": rows["sid"], "size": rows["size"], "n": n, "rate": rows["rate"], "base": found // n, "extra": found % n})

    kind = "sid long, size long, n long, rate double, base long, extra long"
    return stage(rated.select("sid", "size", "n", "rate", "target").groupBy("sid").applyInPandas(copies, kind), "mix-classes")


def _plan(rows: DataFrame, limit: int, cycle: tuple[int, ...], slice_rows: int) -> DataFrame:
    """``rows`` (staged: id, source, size, ...) with sid, words, target, rate and copies."""
    targets = with_targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("docs")), limit, cycle)
    known = broadcast_if_small(targets.select(F.col("source").alias("own"), "sid"))
    counts = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = stage(counts.join(known, F.col("source").eqNullSafe(F.col("own"))).select("sid", "size", "n"), "mix-counts")
    classes = _classes(counts, solve_tilts(counts, targets, limit), limit)

    known = broadcast_if_small(targets.select(F.col("source").alias("own"), "sid", "words", "target"))
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    placed = placed.join(broadcast_if_small(classes), ["sid", "size"], "left")  # an empty text has no class
    mark, slices = F.xxhash64("id"), F.ceil(F.col("n") / slice_rows)
    placed = placed.withColumn("mark", mark).withColumn("slice", F.pmod("mark", slices))
    odd = placed.filter("extra > 0")
    # large classes: documents of the slices before a slice, of which all or none get the odd copy
    cut = odd.filter(F.col("n") > slice_rows).groupBy("sid", "size", "slice").agg(F.count("*").alias("here"))
    up = F.sum("here").over(W.partitionBy("sid", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    cut = stage(cut.select("sid", "size", "slice", F.coalesce(up, F.lit(0)).alias("before")), "mix-slices")
    odd = odd.join(broadcast_if_small(cut), ["sid", "size", "slice"], "left")
    rank = F.row_number().over(W.partitionBy("sid", "size", "slice").orderBy("mark", "id"))
    odd = odd.withColumn("copies", F.col("base") + (rank + F.coalesce("before", F.lit(0)) <= F.col("extra")).cast("long")).drop("before")
    even = placed.filter("extra is null or extra = 0").withColumn("copies", F.coalesce("base", F.lit(0).cast("long")))
    return odd.unionByName(even)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    size = F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *more), "mix-sizes")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = LIMIT,
                cycle: tuple[int, ...] = CYCLE, slice_rows: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, source_size, target, taken, copies and rate.

    Size is the number of runs of characters other than ``[\\x20\\x09-\\x0D]``. Sources in order of code points, null
    last as a source of its own, weigh ``cycle``, repeated, and share all words; no target exceeds ``limit``
    times its source, the rest is shared again by weight. ``copies`` (0 to ``limit``) is how often the document is
    taken, ``taken`` its words times that, ``rate`` the tilted rate before rounding (null for a text without words).

    A null or empty text has size 0 and is taken 0 times. Repeated rows are separate documents; which of some
    rows with equal id, source and size gets an odd copy is not told apart. Null ids are allowed. Very
    long texts are counted whole. An empty table gives an empty result. Other columns are not read.
    """
    plan = _plan(_sizes(docs, id_col, text_col, source_col), limit, cycle, slice_rows)
    return plan.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target",
                       (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = LIMIT,
                    cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, each as often as it is taken.

    Rows are numbered and written once, so a lost task cannot number them anew. Columns of any name may be there.
    """
    number = fresh(docs, "_mix_row")
    kept = stage(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    plan = _plan(_sizes(kept, id_col, text_col, source_col, F.col(number).alias("row")), limit, cycle, SLICE)
    times = stage(plan.filter("copies > 0").select(F.col("row").alias(number), "copies"), "mix-times")
    again = times.select(number, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(number)
    return kept.join(again, number).select(*[F.col(f"`{c}`") for c in docs.columns])
