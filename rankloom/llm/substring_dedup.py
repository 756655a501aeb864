"""Removal of word passages that occur more than once, found through a count-min sketch.

A window is ``size`` consecutive words. Every window has an anchor: of the 8-word grams inside it, the
leftmost one with the least hash. Equal windows have equal anchors at the same distance, and windows that start
elsewhere have them elsewhere, so a window that is repeated has an anchor gram that was picked at two
places at least. Anchors are picked about once in 14 words.

1. Each task counts the anchors it picks in a count-min sketch of saturating cells (0, 1, more). The
   sketches are merged block by block. A cell never shows less than the true count: an estimate below two
   proves that a window is not repeated, and nothing that is repeated is lost.
2. Only windows whose anchor may be repeated are grouped exactly. A row is a run: all windows with one
   anchor occurrence. Runs that are equal as a whole are settled at once; of the others, one run of
   each form is spread into its windows, which are grouped by anchor and words.
3. The words that repeated windows cover are cut out of each text.

Equal means: equal 64-bit hashes of the anchor and of the whole window (or run), made of 64-bit hashes of the words.

The window hashes of the runs are only made for the join that picks the runs to be spread, and are never written as a
table; counting forms needs narrow rows alone. Tables that grow with the corpus are joined by shuffles at every size.

The sketch has ``2 * 2**log2_cells`` cells whatever the input; a fuller sketch lets more windows through to
the exact step, which costs time but changes no result. Two bits a cell travel from the tasks, one is sent to all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stage, text_or_empty
from rankloom.llm.wordhash import chunks, mix, span_hashes, words_of

SIZE, GRAM = 35, 8
LOG2_CELLS, LOG2_BLOCK = 26, 16
#: Tasks whose sketches are merged in one group.
MERGED = 64
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BASE = 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they have been needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            tables = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
            cls.up, cls.down = tables
        return cls.up, cls.down


class Windows:
    """Anchors and window hashes of a few texts; positions count the words of all these texts."""

    def __init__(self, texts: list[bytes], size: int):
        data, starts, ends, self.first = words_of(texts)
        words, n = span_hashes(data, starts, ends, 5), len(starts)
        up, self.down = Powers.to(n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n], dtype=np.uint64)])
        self.size, grams = size, size - GRAM + 1
        count = np.maximum(np.diff(self.first) - size + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), count)
        #: Start of every window.
        self.start = np.arange(len(self.doc)) + np.repeat(self.first[:-1] - (np.cumsum(count) - count), count)
        if not len(self.start):
            self.anchor = self.start
            return
        gram = self.hashes(np.arange(n - GRAM + 1), GRAM)
        bits = np.uint64(max(24, n.bit_length()))
        least, width = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64), 1  # ties go to the left
        while width * 2 <= grams:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < grams:
            least = np.minimum(least[:len(least) - (grams - width)], least[grams - width:])
        #: Word at which the anchor of every window begins; it never moves back within a text.
        self.anchor = (least[self.start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def runs(self) -> np.ndarray:
        """Numbers of the windows at which a new anchor occurrence begins."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])]))


def _cells(grams: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return (grams * FACTORS[row] >> np.uint64(64 - log2_cells)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], size: int, log2_cells: int) -> Iterator[pa.RecordBatch]:
    cells = np.zeros((2, 1 << log2_cells), np.uint8)
    for batch in batches:
        for _, _, texts in chunks(batch.column(1)):
            windows = Windows(texts, size)
            grams = windows.hashes(windows.anchor[windows.runs()], GRAM)
            for row in range(2):
                at, n = np.unique(_cells(grams, row, log2_cells), return_counts=True)
                cells[row, at] = np.minimum(cells[row, at] + np.minimum(n, 2), 2)
    width = 1 << min(LOG2_BLOCK, log2_cells)
    blocks = cells.reshape(-1, width)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(used, pa.int64()), "cells": pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in used], pa.binary())})


def _merged(blocks: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(0, np.uint8)
    for packed in blocks["cells"]:
        cells = np.frombuffer(zlib.decompress(packed), np.uint8)
        total = np.minimum(total + cells, 2) if len(total) else cells
    return pd.DataFrame({"block": blocks["block"].iloc[:1], "part": blocks["part"].iloc[:1] // MERGED, "cells": [zlib.compress(total.tobytes(), 1)]})


def _often(blocks: pd.DataFrame) -> pd.DataFrame:
    cells = np.frombuffer(zlib.decompress(_merged(blocks)["cells"].iloc[0]), np.uint8)
    return pd.DataFrame({"block": blocks["block"].iloc[:1], "often": [np.packbits(cells >= 2).tobytes()]})


def repeated_cells(numbered: DataFrame, size: int, log2_cells: int) -> np.ndarray:
    """One bit per cell of the merged sketch: whether it counts two or more. Its size is fixed.

    Blocks are merged for ``MERGED`` tasks at a time, then for all, so no group holds the sketches of all tasks.
    """
    parts = numbered.mapInArrow(lambda batches: _sketch(batches, size, log2_cells), "block long, cells binary")
    parts = parts.withColumn("part", F.spark_partition_id().cast("long")).withColumn("few", F.expr(f"part div {MERGED}"))
    parts = parts.groupBy("block", "few").applyInPandas(_merged, "block long, part long, cells binary")
    rows = parts.groupBy("block").applyInPandas(_often, "block long, often binary").toPandas()
    width = 1 << min(LOG2_BLOCK, log2_cells)
    bits = np.zeros((2 * (1 << log2_cells) // width, width // 8), np.uint8)
    for block, often in zip(rows["block"], rows["often"]):
        bits[block] = np.frombuffer(often, np.uint8)
    return bits.reshape(2, -1)


def _runs(batches: Iterator[pa.RecordBatch], size: int, log2_cells: int, often: np.ndarray, spread: bool) -> Iterator[pa.RecordBatch]:
    """(gram, form, row, start, length): each run whose anchor may be repeated; form is a hash of all its words.

    With ``spread`` the hashes of its windows come with it.
    """
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for begin, end, texts in chunks(batch.column(1)):
            windows = Windows(texts, size)
            run = windows.runs()
            length = np.diff(np.append(run, len(windows.start)))
            gram = windows.hashes(windows.anchor[run], GRAM)
            maybe = np.ones(len(run), bool)
            for row in range(2):
                at = _cells(gram, row, log2_cells)
                maybe &= (often[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            run, length, gram = run[maybe], length[maybe], gram[maybe]
            if not len(run):
                continue
            doc, start = windows.doc[run], windows.start[run]
            form = mix(windows.hashes(start, length + size - 1) + length.astype(np.uint64) * FACTORS[0])
            columns = {
                "gram": pa.array(gram.view(np.int64)), "form": pa.array(form.view(np.int64)), "row": pa.array(rows[begin:end][doc], pa.int64()),
                "start": pa.array(start - windows.first[doc], pa.int64()), "length": pa.array(length, pa.int64()),
            }
            if spread:
                offsets = np.concatenate([[0], np.cumsum(length)])
                spot = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
                hashes = windows.hashes(np.repeat(start, length) + spot, size)
                columns["windows"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)


def _cut(batches: Iterator[pa.RecordBatch], size: int, id_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in chunks(batch.column(1)):
            data, starts, ends, first = words_of(texts)
            edges = np.zeros(len(starts) + 1, np.int64)
            for i, found in enumerate(batch.column(2).slice(begin, end - begin)):
                if found.is_valid:
                    at = found.values.field(0).to_numpy() + first[i]
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + found.values.field(1).to_numpy() + size - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            # a kept word goes out with the white space that follows it, as a blank
            out, kept = data.copy(), ~gone
            out[ends] = 32
            mask = np.zeros(len(data) + 1, np.int8)
            mask[starts[kept]] += 1
            mask[ends[kept] + 1] -= 1
            chosen = np.cumsum(mask[:-1], dtype=np.int8) > 0
            width = np.concatenate([[0], np.cumsum(np.where(kept, ends - starts + 1, 0))])[first]
            blob, removed = out[chosen].tobytes(), np.concatenate([[0], np.cumsum(gone)])[first]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(begin, end - begin), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(removed), pa.int64()),
                pa.array([blob[a:max(a, b - 1)].decode() for a, b in zip(width.tolist(), width[1:].tolist())], pa.string()),
            ], [id_name, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, log2_cells: int = LOG2_CELLS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_removed and kept_text (kept words, one blank between).

    A word goes if it lies in a window of ``size`` words (at least 8) whose words also start anywhere else, in the
    same text or in another one. Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged.

    A null or empty text has no words; a text with fewer words than ``size`` keeps them all. Repeated rows repeat
    each other. An empty table gives an empty result. Other columns are not read. The rows of ``docs`` must come in
    the same order at every read, as those of a stored table do.
    """
    if size < GRAM:
        raise ValueError(f"size must be at least {GRAM}")
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    often = spark.sparkContext.broadcast(repeated_cells(numbered, size, log2_cells))
    narrow, wide = "gram long, form long, row long, start long, length long", "windows array<long>"
    runs = numbered.mapInArrow(lambda batches: _runs(batches, size, log2_cells, often.value, False), narrow)
    forms = stage(runs.groupBy("gram", "form").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("one")), "forms")
    kinds = forms.groupBy("gram").agg(F.count("*").alias("kinds"))
    forms = forms.join(kinds, "gram").filter("n > 1 or kinds > 1")
    spread = (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("row", "start") == F.col("one")))
    runs = numbered.mapInArrow(lambda batches: _runs(batches, size, log2_cells, often.value, True), f"{narrow}, {wide}")
    placed = stage(runs.join(forms, ["gram", "form"]).select(
        "gram", "n", "row", "start", "length", F.when(spread, F.col("windows")).alias("windows")), "placed")

    whole = placed.filter("n > 1").select("row", "start", "length")
    each = placed.filter("windows is not null").select("gram", "n", "row", "start", F.posexplode("windows").alias("k", "words"))
    again = each.groupBy("gram", "words").agg(F.count("*").alias("m")).filter("m > 1").select("gram", "words")
    single = each.filter("n = 1").join(again, ["gram", "words"]).select("row", (F.col("start") + F.col("k")).alias("start"), F.lit(1).cast("long").alias("length"))
    found = whole.unionByName(single).groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("found"))

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), text_or_empty(text_col).alias("text"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    joined = texts.join(found, "row", "left").select(id_col, "text", "found")
    return joined.mapInArrow(lambda batches: _cut(batches, size, id_col), f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")
