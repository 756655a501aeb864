"""Packing of token sequences by minimum bin slack.

Every document becomes token ids and a closing id 0. It is cut at multiples of the capacity:
whole windows stand alone, and one remainder shorter than a window is left. Remainders are
packed by their lengths alone. For each window the largest remaining length is set first; a
subset-sum dynamic programme over the multiset of remaining lengths, one bit per reachable
total, finds the fullest completion, and backtracking through its layers gives how many pieces
of each length it takes. A pattern found once is used as often as the counts allow.

Each task packs the remainders of its own rows, so nothing is shuffled, and holds the ids of at
most ``pool`` remainders. A length that nothing completes to ``good`` waits for later rows, and the
next length is tried. Pieces that still wait when the pool is half full of them, or at the end of the
task, are cut so that they fill windows; one window a task stays unfilled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty
from rankloom.llm.tokens import word_encoder
from rankloom.llm.wordhash import chunks

CAPACITY = 1024
POOL = 8_192
END_ID = 0
SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: Counter[int], capacity: int) -> Counter[int]:
    """Lengths with multiplicities from ``counts`` whose total comes closest to ``capacity`` from below.

    Layer i holds the totals reachable with the i longest lengths as the bits of one integer.
    Each length enters with counts of 1, 2, 4, ... copies, so every multiplicity up to its count
    can be reached; the layers are read backwards to recover it.
    """
    limit = (1 << capacity + 1) - 1
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            layers.append((length, take, reach))
            reach |= (reach << length * take) & limit
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def fill_windows(counts: Counter[int], capacity: int, least: int) -> list[tuple[Counter[int], int]]:
    """(pattern, times) until no window can be filled to ``least``; takes what it uses from ``counts``.

    A length that no others complete to ``least`` is set aside and the next one is tried. Pieces only go,
    so it stays without a completion, and no later window needs it.
    """
    plan, free, aside = [], +counts, Counter()
    while free:
        first = max(free)
        free[first] -= 1
        pattern = best_fill(free, capacity - first)
        pattern[first] += 1
        free[first] += 1
        if sum(k * n for k, n in pattern.items()) < least:
            aside[first] = free.pop(first)
            continue
        times = min(free[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            free[k] -= n * times
            if not free[k]:
                del free[k]
        plan.append((pattern, times))
    counts.clear()
    counts.update(aside)
    return plan


class _Packer:
    """Pieces of one task; a piece is (document id, start, ids, tokens of the document)."""

    def __init__(self, task: int, capacity: int, pool: int, good: int):
        self.capacity, self.pool, self.good = capacity, pool, good
        self.next_id = task << 40
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        size, cap = len(ids), self.capacity
        for start in range(0, size - cap + 1, cap):
            self.emit([(doc_id, start, ids[start:start + cap], size)])
        if size % cap:
            start = size - size % cap
            self.waiting[size - start].append((doc_id, start, ids[start:], size))
            self.held += 1
            if self.held >= self.pool:
                self.pack(self.good)
                if self.held > self.pool // 2:
                    self.line_up()

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, size in pieces:
            self.out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), size, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def take(self, pattern: Counter[int]) -> list[tuple]:
        pieces = [self.waiting[k].pop() for k in sorted(pattern, reverse=True) for _ in range(pattern[k])]
        self.held -= len(pieces)
        return pieces

    def pack(self, least: int) -> None:
        counts = Counter({k: len(v) for k, v in self.waiting.items() if v})
        for pattern, times in fill_windows(counts, self.capacity, least):
            for _ in range(times):
                self.emit(self.take(pattern))

    def line_up(self) -> None:
        """Put waiting pieces end to end and cut them at the capacity; what fills no window waits on."""
        rest = [p for k in sorted(self.waiting, reverse=True) for p in self.waiting[k]]
        self.waiting.clear()
        window, room = [], self.capacity
        for doc_id, start, ids, size in rest:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((doc_id, start, part, size))
                start, room = start + len(part), room - len(part)
                if not room:
                    self.emit(window)
                    window, room = [], self.capacity
        for piece in window:
            self.waiting[len(piece[2])].append(piece)
        self.held = len(window)

    def finish(self) -> None:
        """Fill what can be filled; the rest is cut into full windows and a last one."""
        self.pack(self.good)
        self.line_up()
        if self.held:
            self.emit([p for k in sorted(self.waiting, reverse=True) for p in self.waiting[k]])
            self.waiting.clear()
            self.held = 0

    def drain(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, pool: int = POOL, good: float = 1.0) -> DataFrame:
    """One row per piece: its document, place in the document and place in its sequence.

    Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the closing id), sequence_id (unique in the table) and
    offset (gapless from 0 in its sequence). A sequence has at most ``capacity`` ids; all but one
    of each task are full, or at least ``good`` times the capacity.

    A null or empty text is the closing id alone. A null id is kept as null; repeated rows are packed
    as often as they come; texts of any length are cut into windows. An empty table gives no pieces.
    Other columns of ``docs`` are not read. A task that is run again gives the same sequences.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    least = max(1, int(capacity * good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        packer, schema = _Packer(TaskContext.get().partitionId(), capacity, pool, least), None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                                          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            doc_ids = batch.column(0).to_pylist()
            for begin, end, texts in chunks(batch.column(1)):
                for doc_id, ids in zip(doc_ids[begin:end], encode([t.decode() for t in texts])):
                    packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                yield packer.drain(schema)
        if schema:
            packer.finish()
            yield packer.drain(schema)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA.format(id_type))


def with_checksum(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


__all__ = ["best_fill", "fill_windows", "pack_documents", "with_checksum"]
