"""Spelling variants: words one edit apart, found through pivotal bigrams.

Bigrams are ordered from rare to frequent. The prefix of a word is its three rarest bigrams. Of these,
dynamic programming picks the two that do not overlap and are rarest together: the pivots. One edit
touches one of two disjoint bigrams at most. So of two words that are one edit apart, the one whose prefix ends
earlier in the order keeps a pivot, and that pivot lies in the other word's prefix. Where both prefixes end in
the same bigram, and it occurs more often, the edit may have brought in two more of them before it: the index has
its first five occurrences.

A pivot that survives has the edit wholly on its left or wholly on its right. The other side is the same in both
words, so the pivot lies equally far from the words' beginning or from their end, with the same letters there: this is
the position limit, and it is part of the key under which prefixes are indexed and pivots look them up, with the
length of the word that is looked for. Candidates are verified inside the join; only true neighbours leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import broadcast_if_small, stage, text_or_empty
from rankloom.llm.substring_dedup import Powers
from rankloom.llm.wordhash import chunks, joined, mix, span_hashes, spans

MIN_POINTS, MIN_COUNT, RATIO, ERASED = 6, 5, 5, 199
#: Letters a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
PREFIX = 3
#: Bigrams that one edit can bring into a word.
TOUCHED = 2
#: Bytes of the longest run whose checksum is worked out for a whole batch at once.
SHORT = 64
#: Distinct words that a task holds before it passes them on.
HELD = 300_000

_LEAD = 0xC3  # first byte of all letters from U+00C0 to U+00FF
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _zero_byte_table() -> np.ndarray:
    """What appending a zero byte does to the low byte of a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_ZERO = _zero_byte_table()


def _checksums(heads: list[bytes], doc: np.ndarray, width: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """CRC-32 of head + tail for tails of ``width`` bytes with checksums ``tails``: the head's, shifted by the width, xor the tail's."""
    shifted = np.empty((SHORT + 1, len(heads)), np.uint32)
    shifted[0] = [crc32(h) for h in heads]
    for i in range(SHORT):
        shifted[i + 1] = (shifted[i] >> np.uint32(8)) ^ _ZERO[shifted[i] & np.uint32(255)]
    return shifted[width, doc] ^ tails


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair, number of the pair at each place)."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _count_runs(heads: list[bytes], texts: list[bytes], min_points: int, erased: int) -> Counter:
    """Occurrences of the words of some texts; runs of fewer than ``min_points`` letters cannot become one."""
    data, begins = joined(texts)
    lead = data == _LEAD
    letter = _IS_LETTER[data] | lead
    letter[1:] |= lead[:-1]
    data = _LOWER[data]
    starts, ends = spans(~letter)
    wide = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (wide[ends] - wide[starts])
    starts, ends, points = (x[points >= min_points] for x in (starts, ends, points))
    if not len(starts):
        return Counter()
    doc = np.searchsorted(begins, starts, side="right") - 1
    first, number = _distinct(span_hashes(data, starts, ends, 1), span_hashes(data, starts, ends, 2))
    blob, width = data.tobytes(), ends - starts
    words = [blob[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    tails = np.array([crc32(w) for w in words], np.uint32)[number]
    short = width <= SHORT
    check = np.zeros(len(starts), np.uint32)
    check[short] = _checksums(heads, doc[short], width[short], tails[short])
    for i in np.flatnonzero(~short).tolist():
        check[i] = crc32(words[number[i]], crc32(heads[doc[i]]))
    changed = check % np.uint32(erased) == 0
    counts = np.bincount(number[~changed], minlength=len(words)).tolist()
    found = Counter({w: n for w, n in zip(words, counts) if n})
    for i in np.flatnonzero(changed).tolist():
        if points[i] > min_points:
            word, at = words[number[i]].decode(), int(check[i]) % int(points[i])
            found[(word[:at] + word[at + 1:]).encode()] += 1
    return found


def _counted(batches: Iterator[pa.RecordBatch], min_points: int, erased: int) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        words = pa.array(found.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict({"word": words, "n": pa.array(found.values(), pa.int64())})

    held: Counter = Counter()
    for batch in batches:
        heads = [f"{i}:".encode() for i in batch.column(0).to_pylist()]
        for begin, end, texts in chunks(batch.column(1)):
            held.update(_count_runs(heads[begin:end], texts, min_points, erased))
            if len(held) > HELD:
                yield out(held)
                held = Counter()
    yield out(held)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_count: int = MIN_COUNT,
                erased: int = ERASED) -> DataFrame:
    """(word, n): words of at least ``min_points`` code points that occur at least ``min_count`` times.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. Of every ``erased``-th run by
    checksum of ``<id>:<run>`` one letter is deleted first. A null id counts as an empty one.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_or_empty(text_col))
    found = rows.mapInArrow(lambda batches: _counted(batches, min_points, erased), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words by number, letters before each word and after the last)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.where(code < 128, code - 97, code - 0xC0 + 26), begins


def _bigrams(letter: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, number) of every bigram, in order."""
    own = np.maximum(np.diff(begins) - 1, 0)
    word = np.repeat(np.arange(len(own)), own)
    place = np.arange(len(word)) + word  # one letter a word begins no bigram
    return word, place, letter[place] * LETTERS + letter[place + 1]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS * LETTERS, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_bigrams(*_letters(batch.column(0).to_pylist()))[2], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})


def pivots(word: np.ndarray, place: np.ndarray, weight: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word two of its bigrams that do not overlap, with the least total weight; ties to the left.

    Bigrams come in order of word and place. ``best`` is the lightest bigram up to the last but one, which
    cannot overlap the next: one step of the programme for all words at once.
    """
    first = np.searchsorted(word, np.arange(n_words + 1))
    count = np.diff(first)
    least, pair = np.full(n_words, np.inf), np.zeros((2, n_words), np.int64)
    best, best_at = np.full(n_words, np.inf), np.zeros(n_words, np.int64)
    active, j = np.flatnonzero(count > 1), 1
    while len(active):
        here = first[active] + j
        apart = place[here - 1] <= place[here] - 2
        last = np.where(apart, weight[here - 1], np.inf)
        take = last < best[active]
        partner, cost = np.where(take, here - 1, best_at[active]), np.where(take, last, best[active]) + weight[here]
        better = cost < least[active]
        won = active[better]
        least[won], pair[0, won], pair[1, won] = cost[better], partner[better], here[better]
        lighter = weight[here - 1] < best[active]
        won = active[lighter]
        best[won], best_at[won] = weight[here - 1][lighter], (here - 1)[lighter]
        j += 1
        active = active[count[active] > j]
    return pair[0], pair[1]


def _keys(side: np.ndarray, gram: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(side + gram.astype(np.uint64) * step) + (size * 2 + which).astype(np.uint64) * step).view(np.int64)


def _entries(batches: Iterator[pa.RecordBatch], counts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Index rows of all prefixes (``probe`` false) and probes of all pivots."""
    freq = np.zeros(LETTERS * LETTERS, np.int64)
    freq[list(counts)] = list(counts.values())
    rank = np.empty(len(freq), np.int64)
    rank[np.lexsort((np.arange(len(freq)), freq))] = np.arange(len(freq))
    for batch in batches:
        for begin, end, texts in chunks(batch.column(0)):
            letter, begins = _letters([t.decode() for t in texts])
            word, place, gram = _bigrams(letter, begins)
            n_words, size, order = end - begin, np.diff(begins), np.lexsort((rank[gram], word))
            first = np.searchsorted(word, np.arange(n_words))
            last, spot = rank[gram][order[first + PREFIX - 1]], np.arange(len(order)) - first[word]
            below = np.bincount(word, weights=rank[gram] < last[word], minlength=n_words).astype(np.int64)
            indexed = np.sort(order[(rank[gram][order] <= last[word]) & (spot < below[word] + PREFIX + TOUCHED)])
            three = np.sort(order[spot < PREFIX])
            chosen = three[np.concatenate(pivots(word[three], place[three], freq[gram[three]], n_words))]

            up, down = Powers.to(len(letter) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((letter + 1).astype(np.uint64) * up[:len(letter)], dtype=np.uint64)])
            at, key, probe = [], [], []
            for found, more in ((indexed, 0), (chosen, -1), (chosen, 0), (chosen, 1)):
                w, p, g = word[found], place[found], gram[found]
                left = mix((sums[p] - sums[begins[w]]) * down[begins[w]])
                right = mix((sums[begins[w + 1]] - sums[p + 2]) * down[p + 2])
                at += [w, w]
                key += [_keys(left, g, size[w] + more, 0), _keys(right, g, size[w] + more, 1)]
                probe.append(np.full(2 * len(found), found is chosen))
            at = np.concatenate(at)
            own = pa.array(at + begin)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate(key)), "probe": pa.array(np.concatenate(probe)), "last": pa.array(last[at], pa.int32()),
                "word": batch.column(0).take(own), "n": batch.column(1).take(own),
            })


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of ``words`` (word, n; staged, distinct) that are one edit apart.

    Words are of letters a-z and U+00C0 to U+00FF, at least four each.
    """
    grams = words.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {r.gram: r.n for r in grams.collect()}  # at most LETTERS * LETTERS rows
    entries = stage(words.select("word", "n").mapInArrow(
        lambda batches: _entries(batches, counts), "key long, probe boolean, last int, word string, n long"), "spelling-entries")
    index = entries.filter("not probe").select("key", F.col("word").alias("y"), F.col("n").alias("n_y"), F.col("last").alias("last_y"))
    probes = entries.filter("probe").select("key", F.col("word").alias("x"), F.col("n").alias("n_x"), "last")
    one_edit = (F.col("last") <= F.col("last_y")) & (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1)
    found = probes.join(index, (probes.key == index.key) & one_edit)
    up = F.col("x") < F.col("y")
    ends = [F.when(up, F.col(p)).otherwise(F.col(q)).alias(name) for p, q, name in
            (("x", "y", "a"), ("n_x", "n_y", "n_a"), ("y", "x", "b"), ("n_y", "n_x", "n_b"))]
    return found.select(*ends).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last, twice as far in every round."""
    known = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = broadcast_if_small(known.select(F.col("word").alias("root"), F.col("root").alias("beyond")))
        after = known.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        after = stage(after, "spelling-roots")
        known = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, erased: int = ERASED) -> DataFrame:
    """One row per word of ``count_words``: word, form, root, n, n_near and form_n.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near word with the most
    occurrences, the first by code points of several, if it has ``ratio`` times those of the word; ``root`` is
    found by following forms, and is the word itself where it has none. ``n_near`` counts near words.

    Null and empty texts have no words; texts and runs of any length are read whole; repeated rows count again, as
    rows with null ids do. An empty table gives an empty result. Other columns are not read.
    """
    if min_points < PREFIX + 1:
        raise ValueError(f"min_points must be at least {PREFIX + 1}")
    words = stage(count_words(docs, id_col, text_col, min_points, min_count, erased), "spelling-words")
    pairs = stage(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other")))
    near = stage(both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    enough = F.col("best.m") >= F.col("n") * ratio
    table = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.m")).alias("form_n"))
    table = stage(table, "spelling-forms")
    roots = _roots(table.filter("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
