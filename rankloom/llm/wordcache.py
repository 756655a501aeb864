"""Ids of words that are worked out once and then found by hash, a whole batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rankloom.llm.wordhash import span_hashes


class WordCache:
    """Maps words (spans of bytes) to lists of ids.

    ``learn`` gets new words and returns their ids, list by list. Known words are kept as sorted arrays,
    about 50 bytes each; beyond ``limit`` words the cache starts anew. Words are told apart by two
    64-bit hashes, and a word whose second hash differs from the one that is stored is an error.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[list[int]]], limit: int = 800_000):
        self.learn, self.limit = learn, limit
        self.forget()

    def forget(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids before each word and after the last)."""
        if len(self.one) > self.limit:
            self.forget()
        one, two = span_hashes(data, starts, ends, 1), span_hashes(data, starts, ends, 2)
        _, index, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[index][inverse]).any():
            raise RuntimeError("two words share a hash")
        one, two = one[index], two[index]
        at = np.searchsorted(self.one, one)
        at[at == len(self.one)] = 0
        new = np.flatnonzero(self.one[at] != one) if len(self.one) else np.arange(len(one))
        if len(new):
            blob = data.tobytes()
            lists = self.learn([blob[s:e] for s, e in zip(starts[index[new]].tolist(), ends[index[new]].tolist())])
            sizes = np.array([len(x) for x in lists], np.int64)
            to = np.searchsorted(self.one, one[new])  # the new hashes are in order, as all of ``one`` is
            self.place = np.insert(self.place, to, len(self.flat) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, to, sizes)
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))])
            self.one, self.two = np.insert(self.one, to, one[new]), np.insert(self.two, to, two[new])
            at = np.searchsorted(self.one, one)
        if (self.two[at] != two).any():
            raise RuntimeError("two words share a hash")
        own = self.size[at][inverse]
        after = np.cumsum(own)
        gather = np.arange(after[-1] if len(after) else 0) + np.repeat(self.place[at][inverse] - (after - own), own)
        return self.flat[gather], np.concatenate([[0], after]).astype(np.int64)
