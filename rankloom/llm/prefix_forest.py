"""Nearest vectors by cosine from a forest of hash prefixes.

Each tree gives a vector a long hash string: random rotations, and of each the coordinate of largest size with its
sign. Vectors with a small angle agree in long prefixes. A tree is a sorted array of these strings, so the vectors
that share a prefix with a query lie side by side. A search descends in every tree to the longest prefix that
still has matches and then ascends in all trees at once, one bit at a time, until the ranges that
share the prefix hold ``enough`` entries in total. All vectors found are scored exactly.

The table is split into shards of bounded size by a hash of the row, each with a forest of its own, and the queries go to
every shard in blocks of bounded size. Equal vectors spread over all shards, so no range is unbounded and
none is cut off. Every valid row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import stage

TREES, SYMBOLS, SEED = 64, 4, 7
SHARD, QUERY_BLOCK, ENOUGH = 4_096, 4_096, 2_000


@lru_cache(maxsize=4)
def _rotations(dim: int, trees: int, symbols: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(trees * symbols)])


def bits_of(dim: int, symbols: int) -> tuple[int, int]:
    """(bits a symbol, symbols that fit): a string has at most 62 bits."""
    bits = max(1, int(2 * dim - 1).bit_length())
    return bits, max(1, min(symbols, 62 // bits))


def hash_strings(vectors: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS, seed: int = SEED) -> np.ndarray:
    """One hash string, as a number, per vector and tree."""
    dim = vectors.shape[1]
    bits, symbols = bits_of(dim, symbols)
    turns = _rotations(dim, trees, symbols, seed)
    out = np.zeros((len(vectors), trees), np.int64)
    for k, turn in enumerate(turns):
        turned = vectors @ turn
        axis = np.abs(turned).argmax(axis=1)
        symbol = axis * 2 + (turned[np.arange(len(vectors)), axis] > 0)
        out[:, k // symbols] = out[:, k // symbols] << bits | symbol
    return out


def search(codes: np.ndarray, asked: np.ndarray, bits: int, enough: int) -> Iterator[np.ndarray]:
    """For each row of ``asked`` the rows of ``codes`` found by synchronous ascent; both are (rows, trees)."""
    trees = codes.shape[1]
    order = np.argsort(codes, axis=0, kind="stable")
    trunks = np.take_along_axis(codes, order, axis=0)
    low, high = np.zeros(asked.shape, np.int64), np.full(asked.shape, len(codes), np.int64)
    active = np.arange(len(asked))
    for up in range(bits + 1):
        base = asked[active] >> up << up
        begin = np.stack([np.searchsorted(trunks[:, t], base[:, t]) for t in range(trees)], axis=1)
        end = np.stack([np.searchsorted(trunks[:, t], base[:, t] + (1 << up)) for t in range(trees)], axis=1)
        low[active], high[active] = begin, end
        active = active[(end - begin).sum(axis=1) < enough]
        if not len(active):
            break
    for q in range(len(asked)):
        found = np.zeros(len(codes), bool)
        for t in range(trees):
            found[order[low[q, t]:high[q, t], t]] = True
        yield np.flatnonzero(found)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal results."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, symbols: int = SYMBOLS, enough: int = ENOUGH, shard_rows: int = SHARD, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of the ``k`` nearest rows found for each row where ``is_query``.

    The score is the cosine of the original vectors in double precision; ties go to the smaller id. All other
    rows are candidates, also those with an equal vector. Vectors that are null, empty, zero or hold a null or
    non-finite number take no part, and vectors of different lengths are not compared. A query with
    fewer candidates than ``k`` gets them all; an empty table gives an empty result. Repeated rows are rows
    of their own. Rows must come in the same order at every read. Other columns are not read.

    Fewer ``enough`` entries make a search cheaper and its recall lower; a shard with fewer is searched whole.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(_valid(F.col("vector")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["dim"] = batch["vector"].map(len)
            for _, part in batch.groupby("dim"):
                part = part.copy()
                part["codes"] = list(hash_strings(np.stack(part["vector"].to_list()), trees, symbols))
                yield part

    indexed = stage(rows.mapInPandas(hashed, "row long, id long, vector array<double>, asks boolean, dim int, codes array<long>"), "forest")
    sizes = indexed.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    sized = indexed.join(F.broadcast(sizes), "dim")  # one row per vector length
    shards, blocks = F.ceil(F.col("n") / shard_rows).cast("int"), F.greatest(F.ceil(F.col("q") / query_rows), F.lit(1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["dim", "shard", "block", "row", "id", "vector", "codes"]
    points = sized.withColumns({"shard": F.pmod(F.xxhash64("row"), shards).cast("int")}).withColumn("block", every(blocks)).select(columns)
    queries = sized.filter("asks").withColumn("block", F.pmod(F.xxhash64(F.lit("query"), "row"), blocks).cast("int")).withColumn("shard", every(shards)).select(*[F.col(c).alias(c) for c in columns])

    def found(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            table, codes = np.stack(own["vector"].to_list()), np.stack(own["codes"].to_list())
            bits, held = bits_of(table.shape[1], symbols)
            ids, numbers = own["id"].to_numpy(), own["row"].to_numpy()
            hits = search(codes, np.stack(asked["codes"].to_list()), bits * held, enough)
            for row, name, query, at in zip(asked["row"], asked["id"], asked["vector"], hits):
                at = at[numbers[at] != row]
                score = cosines(table[at], np.asarray(query))
                best = np.lexsort((ids[at], -score))[:k]
                out += [(row, name, int(ids[at[b]]), float(score[b])) for b in best]
        return pd.DataFrame(out, columns=["row", "query_id", "id", "score"])

    keys = ["dim", "shard", "block"]
    pairs = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(found, "row long, query_id long, id long, score double")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
