"""Near duplicates: BagMinHash signatures, banding, and exact comparison of shingle multisets.

Two texts are linked when the weighted Jaccard similarity of their multisets of five-word
shingles is at least 0.8; a class is a connected component of links.

1. Texts with the same words are one node. Each task signs a text once, and only nodes go on.
2. Nodes that agree in all registers of a band share a bucket. In a bucket every node is compared with one
   leader, the node that shares most buckets with others; an original is central among its copies. So
   a bucket of n nodes gives n - 1 candidates, and a pair found by many bands is one candidate.
3. Where nodes of one leader lie in several components, each node outside the leader's component is held
   against all nodes of that leader, in cells of bounded size. A node is described by its differences from
   the leader, which step 2 has written down: the shingles that one of the two has more often. Two sets of differences
   and their overlap give the similarity of two texts exactly, without the texts. A cell puts out no pairs, only
   links that connect its nodes: fewer than it has nodes.

Nodes that share a bucket have a leader in common, so every pair of a bucket is compared or lies in one component
already. With 42 bands of 6 registers a pair at similarity 0.8 shares no bucket with a chance of 3 in a million.
A leader with o nodes outside its component and n in all costs o * n comparisons, as sums of products of 0/1 matrices.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.bag_minhash import band_keys, multisets, shingles, signatures, weighted_jaccard
from rankloom.llm.common import broadcast_if_small, fresh, stage, text_or_empty
from rankloom.llm.components import components
from rankloom.llm.wordhash import chunks, mix

REGISTERS, BAND_ROWS, SIMILAR = 252, 6, 0.8
#: Nodes and bytes of differences on one side of a cell, about; tokens of one matrix product.
CELL_NODES, CELL_BYTES, TOKENS = 1_024, 12 << 20, 2_048


def _prints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each text's sequence of words."""
    spot = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    both = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + (spot + np.uint64(1)) * salt), dtype=np.uint64)])
        both.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return both[0], both[1]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, seen = batch.column(0).to_numpy(), set()
        for begin, end, texts in chunks(batch.column(1)):
            doc, values, words, first = shingles(texts)
            one, two = _prints(words, first)
            fresh = np.zeros(end - begin, bool)
            for i, pair in enumerate(zip(one.tolist(), two.tolist())):
                if first[i + 1] > first[i] and pair not in seen:
                    seen.add(pair)
                    fresh[i] = True
            number = np.cumsum(fresh) - 1
            own = fresh[doc]
            table = signatures(*multisets(number[doc[own]], values[own]), int(fresh.sum()), REGISTERS)
            keys = band_keys(table, BAND_ROWS).tolist()
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(rows[begin:end], pa.int64()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()),
                "words": pa.array(np.diff(first), pa.int64()),
                "bands": pa.array([keys[number[i]] if fresh[i] else None for i in range(end - begin)], pa.list_(pa.int64())),
            })


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One token for each time that an element of ``a`` or ``b`` (sorted elements, counts) is more often in the one.

    The token tells element, side and how often it was counted before, so that for sets d, e of tokens of
    differences from the same ``b`` the multisets differ by len(d) + len(e) - 2 * len(d & e).
    """
    element = np.union1d(a[0], b[0])
    more = np.zeros(len(element), np.int64)
    more[np.searchsorted(element, a[0])] += a[1]
    more[np.searchsorted(element, b[0])] -= b[1]
    times = np.abs(more)
    at = np.repeat(np.arange(len(element)), times)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return mix(element[at] + (2 * turn + (more[at] > 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[int, tuple] = OrderedDict()

    def bag(row: int, text: pa.Scalar) -> tuple:
        if row not in known:
            doc, values, _, _ = shingles([text.as_py().encode()])
            known[row] = multisets(doc, values)[1:]
            if len(known) > 64:
                known.popitem(last=False)
        return known[row]

    for batch in batches:
        node, leader, text, lead = (batch.column(i) for i in range(4))
        node, leader = node.to_pylist(), leader.to_pylist()
        for begin in range(0, len(node), 256):
            pairs = [(bag(node[i], text[i]), bag(leader[i], lead[i])) for i in range(begin, min(begin + 256, len(node)))]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(node[begin:begin + 256], pa.int64()), "leader": pa.array(leader[begin:begin + 256], pa.int64()),
                "similarity": pa.array([weighted_jaccard(x, y) for x, y in pairs], pa.float64()),
                "weight": pa.array([int(x[1].sum()) for x, _ in pairs], pa.int64()),
                "tokens": pa.array([difference(x, y).tobytes() for x, y in pairs], pa.binary()),
            })


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, leader, similarity, weight, tokens) of all pairs (node, leader): shingles of the node and its differences."""
    left = texts.select(F.col("row").alias("node"), F.col("text").alias("text"))
    right = texts.select(F.col("row").alias("leader"), F.col("text").alias("lead"))
    both = pairs.join(left, "node").join(right, "leader").select("node", "leader", "text", "lead")
    return stage(both.mapInArrow(_similarities, "node long, leader long, similarity double, weight long, tokens binary"), "similarities")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal first ``keys`` columns in batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            part = batch.slice(begin, end - begin)
            if held and any(held[0].column(i)[0].as_py() != v[begin] for i, v in enumerate(values)):
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def spanning_links(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) of a forest that connects what the 0/1 matrix ``linked`` connects; each row and column is met once."""
    row_open, column_open = linked.any(axis=1), np.ones(linked.shape[1], bool)
    for start in range(len(row_open)):
        rows = [start] if row_open[start] else []
        row_open[start] = False
        while rows:
            r = rows.pop()
            for c in np.flatnonzero(linked[r] & column_open).tolist():
                column_open[c] = False
                yield r, c
                more = np.flatnonzero(linked[:, c] & row_open)
                row_open[more] = False
                for other in more.tolist():
                    yield other, c
                rows += more.tolist()


def _overlaps(owner: np.ndarray, token: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Tokens that each of the owners ``rows`` shares with each of ``n`` owners."""
    _, number, held = np.unique(token, return_inverse=True, return_counts=True)
    shared = held[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    total = np.zeros((len(rows), n), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, TOKENS):
        begin, end = np.searchsorted(number, (low, low + TOKENS))
        has = np.zeros((n, TOKENS), np.float32)
        has[owner[begin:end], number[begin:end] - low] = 1
        total += has[rows] @ has.T
    return total


def _cell_links(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components that connect the nodes of each cell."""
    for cell in _groups(batches, 3):
        node, first = np.unique(cell.column("node").to_numpy(), return_index=True)  # an odd node of the cell's both sides comes twice
        asks = np.isin(node, cell.column("node").to_numpy()[cell.column("asks").to_numpy() == 1])
        comp, weight = (cell.column(name).to_numpy()[first] for name in ("comp", "weight"))
        packed = cell.column("tokens").take(pa.array(first)).to_pylist()
        size, rows = np.array([len(t) // 8 for t in packed]), np.flatnonzero(asks)
        shared = _overlaps(np.repeat(np.arange(len(node)), size), np.frombuffer(b"".join(packed), np.uint64), rows, len(node))
        apart = size[rows][:, None] + size - 2 * shared.astype(np.int64)
        both = weight[rows][:, None] + weight
        linked = ((both - apart) / np.maximum(both + apart, 1) >= similar) & (comp[rows][:, None] != comp)
        found = [(node[rows[r]], node[c]) for r, c in spanning_links(linked)]
        if found:
            a, b = (np.array(x, np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _open_links(tested: DataFrame, comps: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between components that meet under a leader."""
    known = broadcast_if_small(comps)
    placed = tested.select("node", "leader", "weight", "tokens").join(known.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left")
    placed = placed.join(known.select(F.col("u").alias("leader"), F.col("v").alias("main")), "leader", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node")).withColumn("odd", F.col("comp") != F.coalesce("main", "leader"))

    def parts(of: Column, name: str) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(of, F.length("tokens"))) / CELL_BYTES), F.ceil(F.count(F.when(of, 1)) / CELL_NODES), F.lit(1)).cast("int").alias(name)

    groups = placed.groupBy("leader").agg(F.count("*").alias("n"), F.count(F.when(F.col("odd"), 1)).alias("n_odd"), parts(F.col("odd"), "high"), parts(F.lit(True), "wide"))
    groups = stage(groups.filter("n_odd > 0 and n > 1").select("leader", "high", "wide"), "open-leaders")
    rows = placed.join(broadcast_if_small(groups), "leader")
    mark = F.xxhash64("node")
    odd = rows.filter("odd").select("leader", F.pmod(mark, "high").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"),
                                    "node", "comp", "weight", "tokens", F.lit(1).alias("asks"))
    every = rows.select("leader", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(mark, "wide").cast("int").alias("j"),
                        "node", "comp", "weight", "tokens", F.lit(0).alias("asks"))
    cells = odd.unionByName(every).repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return stage(cells.mapInArrow(lambda batches: _cell_links(batches, similar), "a long, b long"), "open-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_row", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs`` with its class of near duplicates.

    Columns: ``key`` (position in ``docs``, whose rows must come in the same order at every read, as
    those of a stored table do), ``id_col``, class_id (smallest id of the class), class_size, kept (true for
    one row of each class, the one with the smallest id, then the first).

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged. A text of one to four
    words has one shingle, all of it. Null and empty texts have no shingle and are alone.
    Repeated rows are one class. A null id sorts last. An empty table gives an empty result.
    Other columns of ``docs`` are not read; texts of any length are compared whole.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sketch = stage(numbered.select("row", "text").mapInArrow(
        _sketches, "row long, one long, two long, words long, bands array<long>"), "sketches")

    shared = stage(sketch.filter("words > 0").groupBy("one", "two").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    marked = sketch.join(broadcast_if_small(shared), ["one", "two"], "left").withColumn("node", F.coalesce("first", "row"))
    nodes = marked.filter("bands is not null and node = row")

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(keyed.join(sizes, "key"), "members")
    central = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("central"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("leader"))
    members = members.join(leaders, "key")
    pairs = stage(members.filter("node <> leader").select("node", "leader").distinct(), "led")
    wanted = stage(pairs.select(F.explode(F.array("node", "leader")).alias("row")).distinct(), "wanted")
    texts = stage(numbered.join(broadcast_if_small(wanted), "row", "left_semi").select("row", "text"), "texts")
    tested = _verified(pairs, texts)
    links = tested.filter(F.col("similarity") >= similar).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    comps = components(links)
    more = _open_links(tested, comps, similar)
    if not more.isEmpty():
        comps = components(comps.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))

    placed = marked.select("row", "node").join(broadcast_if_small(comps.withColumnRenamed("u", "node")), "node", "left")
    placed = numbered.select("row", "id").join(placed.select("row", F.coalesce("v", "node").alias("class")), "row")
    placed = stage(placed, "placed")
    best = F.min_by(F.struct("id", "row"), F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
    groups = stage(placed.groupBy("class").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1"), "classes")
    result = placed.join(broadcast_if_small(groups), "class", "left")
    alone = F.col("size").isNull()
    return result.select(
        F.col("row").alias(key), F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("best.row") == F.col("row"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with its own columns and one row of each class."""
    key = fresh(docs, "_near_dedup_row")
    dropped = stage(near_duplicates(docs, id_col, text_col, key, similar).filter("not kept").select(key), "dropped")
    return docs.withColumn(key, F.monotonically_increasing_id()).join(broadcast_if_small(dropped), key, "left_anti").drop(key)
