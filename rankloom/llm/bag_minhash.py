"""BagMinHash signatures of multisets of word shingles.

Element d with weight c is the strip [0, c) of weights. Weights are discretised at 0, 1, 2, 4, 8, ...:
the part of the strip between two of these marks has one Poisson process per element, whose rate is the
length of that part, so a heavy element costs the logarithm of its weight. Each point has a time,
a register and a height in its part; points above c are passed over, which leaves exactly the
points of [0, c). A register keeps the earliest time that fell on it. Two multisets agree in a
register with the chance sum(min) / sum(max), their weighted Jaccard similarity.

Points are drawn in order of time until a document's registers are all filled, so few of them
are drawn beyond the m log m that fill m registers.
"""

from __future__ import annotations

import numpy as np

from rankloom.llm.wordhash import mix, span_hashes, words_of

STEP, TO_UNIT = np.uint64(0x9E3779B97F4A7C15), 2.0 ** -53
SHINGLE = 5


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * TO_UNIT


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each shingle, hash of each shingle, word hashes, words before each document).

    A document with fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    data, starts, ends, first = words_of(texts)
    words = span_hashes(data, starts, ends, 3)
    count = np.diff(first)
    if len(words) < size:
        words_padded = np.concatenate([words, np.zeros(size, np.uint64)])
    else:
        words_padded = words
    rolling = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rolling = mix(rolling + words_padded[k:k + len(rolling)] * STEP) if len(rolling) else rolling
    own = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(texts)), own)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(own) - own), own)
    values = rolling[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            few[has] = mix(few[has] + words[first[short[has]] + k] * STEP)
        doc, values = np.concatenate([doc, short]), np.concatenate([values, mix(few + count[short].astype(np.uint64))])
    return doc, values, words, first


def multisets(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count), ordered by document and element."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], values[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Times of the registers, one row a document; infinite where a document has no element."""
    low = np.concatenate([[0], 2 ** np.arange(62)]).astype(np.float64)  # lower marks of the parts
    rate_of = np.concatenate([[1], 2 ** np.arange(62)]).astype(np.float64)
    parts = np.searchsorted(low, count, side="left")
    owner = np.repeat(np.arange(len(doc)), parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    of, rate = doc[owner], rate_of[part]
    reach = np.minimum((count[owner] - low[part]) / rate, 1.0)
    state = mix(mix(element[owner]) + STEP * (part + 1).astype(np.uint64))
    time = -np.log(_unit(state)) / rate

    table = np.full(n_docs * registers, np.inf)
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    limit = np.where(weight > 0, registers / np.maximum(weight, 1) * (np.log(registers) + 2), 0.0)
    while True:
        active = np.flatnonzero(time < limit[of])
        while len(active):
            place = mix(state[active] + STEP)
            height = _unit(mix(place + STEP))
            hit = height <= reach[active]
            slot = of[active] * registers + (place % np.uint64(registers)).astype(np.int64)
            np.minimum.at(table, slot[hit], time[active][hit])
            state[active] = mix(state[active] ^ STEP)
            time[active] -= np.log(_unit(state[active])) / rate[active]
            active = active[time[active] < limit[of[active]]]
        unfilled = np.isinf(table.reshape(n_docs, registers)).any(axis=1) & (weight > 0)
        if not unfilled.any():
            return table.reshape(n_docs, registers)
        limit[unfilled] *= 2


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers; the number of the band is part of the key."""
    n, registers = table.shape
    bits = np.ascontiguousarray(table).view(np.uint64).reshape(n, registers // rows, rows)
    keys = np.broadcast_to(np.arange(registers // rows, dtype=np.uint64) * STEP, bits.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys + bits[:, :, k])
        keys *= np.uint64(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two (sorted elements, counts); 0 if both are empty."""
    common, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][to]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - both
    return both / total if total else 0.0
