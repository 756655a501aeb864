"""Ranked lexical search for many items at once, with common subexpressions evaluated once.

An item's score of a document is a sum over its terms, so items that share terms share partial sums.

1. Terms that occur in the same items form one node: its partial sum is needed by all of them or by none.
2. Shared sets are mined in rounds: nodes are dealt out by a min-hash of their sets of items, which brings those together that
   occur in the same items, and neighbours with at least two items in common become a new node, the sum of both, that
   replaces them in these items. The nodes form a directed graph in which each node is added up once and read
   by all nodes and items above it.
3. One scan of the documents counts the items' terms, the rest of a text only by length. Counts are summed for the corpus
   statistics and written as narrow rows (document, length, terms, frequencies).
4. A second scan of these rows fills the accumulators of a few hundred documents at a time along the graph, level by level, and
   keeps the best rows per item in each task; these few are ranked per item in the end.

Items are worked off in blocks, so that graph and accumulators are of bounded size whatever the number of items;
documents meet each block and are never paired with items as rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.common import stage, text_or_empty, union_all
from rankloom.llm.wordhash import chunks, joined, mix, span_hashes, spans

TOP = 10
#: Items, and bytes of their texts, whose graph is held at once.
BLOCK_ITEMS, BLOCK_BYTES = 512, 4 << 20
ROUNDS = 24
#: Cells of the accumulators of one step (8 bytes each).
CELLS = 2_000_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = np.ones(256, bool)
_IS_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: Column) -> Column:
    """The different terms of a text, only A-Z in lower case."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))


@dataclass
class Graph:
    """``leaf`` is the node of each term; node ``first + i`` is the sum of the nodes ``left[i]`` and ``right[i]``.

    ``levels`` cuts the sums into runs that need only earlier ones. ``item`` and ``node`` list the nodes each item adds up.
    """

    leaf: np.ndarray
    first: int
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    item: np.ndarray
    node: np.ndarray
    n_items: int

    @property
    def size(self) -> int:
        return self.first + len(self.left)


def share(items: list[set[int]], n_terms: int, rounds: int = ROUNDS) -> Graph:
    """The graph that adds up the sets of terms ``items``, with sums that several items need made once."""
    used: list[list[int]] = [[] for _ in range(n_terms)]
    for i, own in enumerate(items):
        for t in own:
            used[t].append(i)
    atoms: dict[tuple[int, ...], int] = {}
    leaf = np.array([atoms.setdefault(tuple(u), len(atoms)) for u in used], np.int64)
    holders = [set(a) for a in atoms]
    first, left, right, levels = len(holders), [], [], []
    open_nodes = [v for v, h in enumerate(holders) if len(h) > 1]
    numbers = np.arange(len(items), dtype=np.uint64)
    for r in range(rounds):
        if len(open_nodes) < 2:
            break
        place = mix(mix(numbers + np.uint64(r + 1)) + np.uint64(r)).tolist()
        dealt = sorted(open_nodes, key=lambda v: (*sorted(place[i] for i in holders[v])[:3], v))
        begin, at = len(left), 0
        while at + 1 < len(dealt):
            a, b = dealt[at:at + 2]
            both = holders[a] & holders[b]
            if len(both) < 2:
                at += 1
                continue
            left.append(a)
            right.append(b)
            holders.append(both)
            holders[a], holders[b] = holders[a] - both, holders[b] - both
            at += 2
        if len(left) > begin:
            levels.append((begin, len(left)))
        open_nodes = [v for v, h in enumerate(holders) if len(h) > 1]
    ends = [(i, v) for v, h in enumerate(holders) for i in sorted(h)]
    item, node = (np.array(x, np.int64) for x in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
    order = np.argsort(item, kind="stable")
    return Graph(leaf, first, np.array(left, np.int64), np.array(right, np.int64), levels, item[order], node[order], len(items))


def accumulate(graph: Graph, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums of ``value`` (of a term in a document) by item and document."""
    cells = np.zeros((graph.size, n_docs), np.int64)
    np.add.at(cells, (graph.leaf[term], doc), value)
    for begin, end in graph.levels:
        cells[graph.first + begin:graph.first + end] = cells[graph.left[begin:end]] + cells[graph.right[begin:end]]
    total = np.zeros((graph.n_items, n_docs), np.int64)
    if len(graph.item):
        starts = np.flatnonzero(np.diff(graph.item, prepend=-1))
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(graph.item)]):
            total[graph.item[begin]] = cells[graph.node[begin:end]].sum(axis=0)
    return total


class Vocabulary:
    """Numbers of known terms, found by two 64-bit hashes."""

    def __init__(self, terms: list[str]):
        data, begins = joined([t.encode() for t in terms])
        starts, ends = begins[:-1], begins[1:] - 1
        one = span_hashes(data, starts, ends, 1)
        self.order = np.argsort(one)
        self.one, self.two = one[self.order], span_hashes(data, starts, ends, 2)[self.order]
        if (self.one[1:] == self.one[:-1]).any():
            raise ValueError("two terms share a hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of known terms, their numbers)."""
        if not len(self.one):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        one = span_hashes(data, starts, ends, 1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        known = np.flatnonzero(self.one[at] == one)
        at = at[known]
        same = span_hashes(data, starts[known], ends[known], 2) == self.two[at]
        return known[same], self.order[at[same]]


def _lists(doc: np.ndarray, n_docs: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), pa.array(values, kind))


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, n_terms: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in chunks(batch.column(1)):
            data, begins = joined(texts)
            data = _LOWER[data]
            starts, ends = spans(~_IS_TERM[data])
            first = np.searchsorted(starts, begins)
            known, term = vocabulary.find(data, starts, ends)
            doc = np.searchsorted(first, known, side="right") - 1
            pair, times = np.unique(doc * n_terms + term, return_counts=True)
            doc, term = pair // max(n_terms, 1), pair % max(n_terms, 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(begin, end - begin), pa.array(np.diff(first), pa.int64()),
                _lists(doc, end - begin, term, pa.int32()), _lists(doc, end - begin, times, pa.int64()),
            ], ["id", "n", "terms", "times"])


def _merge(kept: pa.Table | None, found: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows per item by score, then id, nulls last."""
    table = found if kept is None else pa.concat_tables([kept, found])
    keys = [("item", "ascending"), ("score", "descending"), ("id", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
    item = table.column("item").to_numpy()
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return table.filter(pa.array(rank < top))


def _best(batches: Iterator[pa.RecordBatch], graph: Graph, weight: np.ndarray, total: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    """The best ``top`` documents of this task for each item."""
    kept, floor = None, np.zeros(graph.n_items, np.int64)
    width = max(CELLS // max(graph.size + graph.n_items, 1), 1)
    for batch in batches:
        for begin in range(0, batch.num_rows, width):
            part = batch.slice(begin, width)
            n, terms, times = part.column(1).to_numpy(), part.column(2), part.column(3).flatten().to_numpy()
            doc, term = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy()), terms.flatten().to_numpy()
            m = 10 + 90 * n * total // max(length, 1)
            value = weight[term] * (1_000_000_000 * times // (1_000 * times + 8 * m[doc]))
            scores = accumulate(graph, doc, term, value, part.num_rows)
            # a document that ties with the last kept one may still come before it
            item, at = np.nonzero((scores >= floor[:, None]) & (scores > 0))
            if not len(item):
                continue
            found = pa.table({"item": pa.array(item, pa.int32()), "id": part.column(0).take(pa.array(at)), "score": pa.array(scores[item, at], pa.int64())})
            kept = _merge(kept, found, top)
            own, count = np.unique(kept.column("item").to_numpy(), return_counts=True)
            last = kept.column("score").to_numpy()[np.cumsum(count) - 1]
            floor[own[count == top]] = last[count == top]
    if kept is not None:
        yield from kept.combine_chunks().to_batches()


def _blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple[int, set[str]]]]:
    """Items with their terms, a block of bounded number and size at a time, in order."""
    block, size = [], 0
    for row in items.sort("number").toLocalIterator(prefetchPartitions=False):
        block.append((row.number, set(row.terms)))
        size += sum(len(t) for t in row.terms)
        if len(block) == block_items or size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(rows: DataFrame, block: list[tuple[int, set[str]]], kind: str, top: int) -> DataFrame:
    """(number, id, score): the best rows of each task for the items of one block."""
    words = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(words)}
    graph, vocabulary, n_terms = share([{number[t] for t in own} for _, own in block], len(words)), Vocabulary(words), len(words)
    counted = stage(rows.mapInArrow(
        lambda batches: _counts(batches, vocabulary, n_terms), f"id {kind}, n long, terms array<int>, times array<long>"), "search-counts")
    total, length = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in holders.collect():  # at most the terms of one block
        df[row.term] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    best = counted.filter(F.size("terms") > 0).mapInArrow(
        lambda batches: _best(batches, graph, weight, total, length, top), f"item int, id {kind}, score long")
    names = F.array(*[F.lit(i) for i, _ in block])
    return stage(best.select(F.element_at(names, F.col("item") + 1).alias("number"), "id", "score"), "search-best")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``top`` documents for each row of ``items``: ``item_col``, rank (from 1), ``id_col``, score.

    Terms are runs of characters other than ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z in lower case. With N documents that have
    a term, L terms in all, n terms of a document, df documents with a term and tf its occurrences in the document,
    a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))) and a score sums w * (10^9 tf div (1000 tf + 8 m)) over the
    item's different terms, m = 10 + (90 n N) div L. Only scores above 0 count; equal ones go by id, null last.

    Null and empty texts have no term; texts of any length are counted whole. Repeated rows are separate documents,
    and repeated items are each answered. Empty tables give an empty result. Other columns are not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item"), terms_of(F.col(item_text_col)).alias("terms"))
    numbered = stage(numbered, "search-items")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    parts = [_search_block(rows, block, kind, top) for block in _blocks(numbered.filter(F.size("terms") > 0), block_items)]
    found = union_all(parts) if parts else rows.select(F.lit(0).cast("long").alias("number"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("number", "item"), "number").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
