"""Language of a text by rank-order profiles of letter n-grams.

A profile is the list of the ``PROFILE`` most frequent n-grams of one to three signs, most frequent first,
ties by code. Words are lower-case runs of letters with a blank on either side. The distance of a text to
a language sums, over the n-grams of the text's own profile, how far each is out of place in the language's
profile; an n-gram that is not there counts as ``PROFILE`` places. The nearest language wins, ties by name.

The profiles are learnt from all rows given: each task sums its n-grams by language, so what is
shuffled is bounded by tasks x languages x distinct n-grams and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty

PROFILE, LANGUAGES, UNKNOWN = 400, 2_000, "und"
CHUNK, BLANK = 2 << 20, np.uint64(32)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, sign) with one blank before and after each word; signs beyond 16 bits are folded."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(points)), [len(p) for p in points])
    sign = np.concatenate(points)
    letter = _is_letter()[sign]
    sign = np.where(letter, np.where(sign > 0xFFFF, 0xE000 + sign % 0x1900, sign), 32).astype(np.uint64)
    start = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = letter | start | np.concatenate([[False], letter[:-1]])
    return doc[keep], sign[keep]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of every n-gram; a code is up to three signs of 16 bits, never with a blank inside."""
    doc, sign = _signs(texts)
    same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    one = sign != BLANK
    two = same1 & (one[1:] | one[:-1])
    three = same2 & one[1:-1] if len(sign) > 2 else np.zeros(0, bool)
    s16, s32 = np.uint64(16), np.uint64(32)
    return (np.concatenate([doc[one], doc[:-1][two], doc[:-2][three]]),
            np.concatenate([sign[one], ((sign[:-1] << s16) | sign[1:])[two], ((sign[:-2] << s32) | (sign[1:-1] << s16) | sign[2:])[three]]))


def counted(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count) ordered by group and code; at most 65,536 groups."""
    keys = np.sort((group.astype(np.uint64) << np.uint64(48)) | code)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    keys_at = keys[at]
    return (keys_at >> np.uint64(48)).astype(np.int64), keys_at & np.uint64((1 << 48) - 1), np.diff(np.append(at, len(keys)))


def ranked(group: np.ndarray, code: np.ndarray, count: np.ndarray, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, rank) of the ``size`` most frequent codes of each group, from rank 0."""
    order = np.lexsort((-count, group))  # stable: codes of equal count stay in ascending order
    group, code = group[order], code[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    top = rank < size
    return group[top], code[top], rank[top]


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and (held + len(text) > CHUNK or i - begin >= 60_000):
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of one task; sums are folded together as they come."""
    names: dict[str, int] = {}
    held: list[tuple] = []

    def fold() -> tuple:
        group, code, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((code, group))
        group, code, n = group[order], code[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])]))
        return group[at], code[at], np.add.reduceat(n, at)

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for begin, end in _pieces(texts):
            numbers = np.array([names.setdefault(x, len(names)) for x in langs[begin:end]])
            doc, code = ngrams(texts[begin:end])
            if len(code):
                held.append(counted(numbers[doc], code))
            if len(held) > 16:
                held = [fold()]
    if held:
        group, code, n = fold()
        of = list(names)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([of[g] for g in group.tolist()], pa.string()), "code": pa.array(code.astype(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """For each language its codes in order of rank. Rows with a null language or text are left out.

    ``size`` codes for each of at most ``LANGUAGES`` languages reach the driver; more languages are an error.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    sums = rows.mapInArrow(_sums, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = sums.withColumn("rank", place).filter(F.col("rank") <= size).limit(LANGUAGES * size + 1).toPandas()
    if len(top) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {lang: part.sort_values("rank").code.to_numpy(np.uint64) for lang, part in sorted(top.groupby("lang"), key=lambda x: x[0])}


def predict(texts: list[str], profiles: dict[str, np.ndarray], size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """(languages, scores) of texts; the score is 1 - distance / largest possible distance."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not profiles or not texts:
        return langs, scores
    group, code, rank = ranked(*counted(*ngrams(texts)), size)
    grams = np.bincount(group, minlength=len(texts))
    distance = np.empty((len(profiles), len(texts)))
    for k, codes in enumerate(profiles.values()):
        order = np.argsort(codes)
        at = np.minimum(np.searchsorted(codes[order], code), len(codes) - 1)
        there = codes[order][at] == code
        distance[k] = np.bincount(group, weights=np.where(there, np.abs(order[at] - rank), size), minlength=len(texts))
    names, best = list(profiles), distance.argmin(axis=0)
    known = grams > 0
    scores[known] = 1 - distance.min(axis=0)[known] / (size * grams[known])
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], scores


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score (0 to 1) of every row of ``docs``.

    A text that is null, empty or without letters is ``und`` with score 0, as is every text when there are
    no profiles. Only the text decides: repeated rows agree; texts of any length are read whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, scores = batch.column(1).to_pylist(), [], []
            for begin, end in _pieces(texts):
                langs, own = predict(texts[begin:end], profiles)
                found += langs
                scores.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
