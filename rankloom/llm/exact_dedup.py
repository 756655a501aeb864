"""Exact duplicates by distributed MSD radix partitioning.

A text is a string of bytes with its byte length in front. Groups of texts are split by
successive blocks of bytes until a group is a singleton or its texts have ended; two texts
are equal only because every byte was compared, never because a digest agreed.

1. First split, over the whole table: (length, first bytes). Only narrow keys are shuffled
   and counted with map-side partial sums. Most rows are alone in their group and are done.
2. Rows in groups of two and more are collapsed inside each Arrow batch by the same
   recursion, so that one row of each text per batch goes on. A text that a third of all
   rows share meets the next shuffle with one row per batch and not with all its copies.
3. The rows that go on are split by blocks that grow sixteenfold, one shuffle per block.
   A group that is alone, or whose texts have ended, leaves. Groups are counted by partial sums, so
   copies of a hot text never meet in one task; in the join back Spark splits a hot key on the row side.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import SPACES, broadcast_if_small, fresh, stage, text_or_empty, union_all

#: Bytes of the first split, of the next one, and the growth from split to split.
HEAD_BYTES = 16
BLOCK_BYTES = 256
GROWTH = 16


def radix_leaders(texts: list[bytes], block: int = 64) -> list[int]:
    """For each text the index of the first equal one, by recursive splits on blocks of bytes."""
    leader = list(range(len(texts)))
    open_groups = [(list(range(len(texts))), 0, block)]
    while open_groups:
        members, at, width = open_groups.pop()
        parts: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for i in members:
            parts[len(texts[i]), texts[i][at:at + width]].append(i)
        for (length, _), part in parts.items():
            if len(part) == 1:
                continue
            if length <= at + width:
                for i in part:
                    leader[i] = part[0]
            else:
                open_groups.append((part, at + width, width * 2))
    return leader


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Point every open row at the first equal row of its batch; only that row keeps its bytes."""
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        rows, texts = columns["_row"].to_pylist(), columns["_bytes"].to_pylist()
        open_rows = [i for i, text in enumerate(texts) if text is not None]
        leaders = list(rows)
        first = radix_leaders([texts[i] for i in open_rows])
        for i, j in zip(open_rows, first):
            if open_rows[j] != i:
                leaders[i], texts[i] = rows[open_rows[j]], None
        columns["_leader"] = pa.array(leaders, pa.int64())
        columns["_bytes"] = pa.array(texts, pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def _split_until_done(open_rows: DataFrame) -> DataFrame:
    """(_leader, _class) of all rows that share a text with a row of another batch."""
    done = []
    at, width, group = HEAD_BYTES + 1, BLOCK_BYTES, ["_n", "_head"]
    state = open_rows
    while True:
        digit = F.substring("_bytes", at, width)
        keyed = state.withColumn("_digit", digit)
        sizes = keyed.groupBy(*group, "_digit").agg(F.count("*").alias("_size"), F.min("_leader").alias("_class"))
        state = keyed.join(sizes.filter("_size > 1"), [*group, "_digit"]).withColumn("_group", F.col("_class"))
        state = stage(state.select("_leader", "_n", "_group", F.when(F.col("_n") >= at + width, F.col("_bytes")).alias("_bytes")), "radix")
        done.append(state.filter("_bytes is null").select("_leader", F.col("_group").alias("_class")))
        state = state.filter("_bytes is not null")
        if state.isEmpty():
            return union_all(done)
        at, width, group = at + width, width * GROWTH, ["_group"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_row") -> DataFrame:
    """One row per row of ``docs`` with its class of equal texts.

    Texts are equal when identical after all of ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts
    the row with the most code points in the original stays, then the smallest id, then the first
    row. Columns: ``key`` (position in ``docs``, whose rows must come in the same order at every
    read, as those of a stored table do), ``id_col``, keep_id, group_size, kept, text_sha256
    (of the normalised text; a report, not used to compare).

    A null text is an empty one, and all empty texts are equal. Ids are of any type that sorts; a null id sorts after
    all ids. Texts of any length are compared whole: longer ones take more splits, each sixteen times as wide.
    Repeated rows are copies of each other: one stays. An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    norm = F.translate(text_or_empty(text_col), SPACES, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        F.length(text_or_empty(text_col)).cast("long").alias("_points"), norm.cast("binary").alias("_bytes"),
    ).withColumns({"_n": F.octet_length("_bytes").cast("long"), "_head": F.substring("_bytes", 1, HEAD_BYTES)})

    shared = stage(rows.groupBy("_n", "_head").count().filter("count > 1").select("_n", "_head", F.lit(True).alias("_open")), "heads")
    marked = rows.join(broadcast_if_small(shared), ["_n", "_head"], "left").select(
        "_row", "_id", "_points", "_n", "_head", F.sha2("_bytes", 256).alias("_sha"),
        F.when(F.col("_open"), F.col("_bytes")).alias("_bytes"), F.coalesce("_open", F.lit(False)).alias("_open"),
    )
    schema = "_row long, _id {}, _points long, _n long, _head binary, _sha string, _bytes binary, _open boolean, _leader long".format(
        docs.select(id_col).schema[0].dataType.simpleString())
    local = stage(marked.mapInArrow(_collapse, schema), "collapsed")

    short = F.col("_n") <= HEAD_BYTES  # ended at the first split
    ended = local.filter(F.col("_bytes").isNotNull() & short).groupBy("_n", "_head").agg(F.min("_leader").alias("_class"))
    ended = local.filter(F.col("_bytes").isNotNull() & short).join(ended, ["_n", "_head"]).select("_leader", "_class")
    split = _split_until_done(local.filter(F.col("_bytes").isNotNull() & ~short).select("_leader", "_n", "_head", "_bytes"))
    classes = stage(ended.unionByName(split), "classes")

    members = local.filter("_open").select("_row", "_id", "_points", "_sha", "_leader")
    members = members.join(broadcast_if_small(classes), "_leader", "left").withColumn("_class", F.coalesce("_class", "_leader"))
    best = F.min(F.struct((-F.col("_points")).alias("_short"), F.col("_id").isNull().alias("_unknown"), "_id", "_row"))
    groups = stage(
        members.groupBy("_class").agg(F.count("*").alias("_size"), best.alias("_best")).filter("_size > 1"), "groups")
    members = members.join(broadcast_if_small(groups), "_class", "left")
    result = members.unionByName(local.filter("not _open").select("_row", "_id", "_points", "_sha", "_leader"), allowMissingColumns=True)
    alone = F.col("_size").isNull()
    return result.select(
        F.col("_row").alias(key), F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_best._row") == F.col("_row"))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns and only the row of each text that stays."""
    key = fresh(docs, "_exact_dedup_row")
    dropped = stage(exact_duplicates(docs, id_col, text_col, key).filter("not kept").select(key), "dropped")
    return docs.withColumn(key, F.monotonically_increasing_id()).join(broadcast_if_small(dropped), key, "left_anti").drop(key)
