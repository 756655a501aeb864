"""Token ids of many texts by a byte-level BPE tokenizer, one distinct word at a time."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from rankloom.llm.wordcache import WordCache
from rankloom.llm.wordhash import joined

#: Distinct pre-tokens that are remembered while new words are met.
CACHE_PARTS = 60_000
#: Signs that end a word as pre-tokens of their own.
TAIL = ".,;:!?*%&#$\"()|-"


def _byte_letters() -> dict[int, str]:
    """The letters of byte-level BPE: a printable byte is itself, the n-th other byte is 256 + n."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}


class WordEncoder:
    """Ids (no special tokens added) of texts; equal to the tokenizer's own on every text.

    Byte-level BPE merges inside pre-tokens only, and a blank between two visible characters
    always begins a pre-token, as does a sign after a letter. So a text is the sum of its words, each
    with the blank before it, and repeated words are encoded once. Texts in which another white
    space, or the end, follows a blank are encoded whole, as are those with a special token, and
    all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.by_word = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile("|".join([r" (?:\s|$)", *map(re.escape, specials)]))
        self.letters = _byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.cache = WordCache(self._learn)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        parts, tokenize = self.parts, self.tokenizer.model.tokenize
        if len(parts) > CACHE_PARTS:
            parts.clear()

        def part(text: str) -> list[int]:
            ids = parts.get(text)
            if ids is None:
                ids = parts[text] = [t.id for t in tokenize(text.encode().decode("latin-1").translate(self.letters))]
            return ids

        lists = []
        for word in map(bytes.decode, words):
            core = word.rstrip(TAIL)
            tail = word[len(core):]
            if core.removeprefix(" ").isalpha():
                lists.append(part(core) + part(tail) if tail else part(core))
            else:
                lists.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return lists

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and not self.unusual.search(t) for t in texts]
        usual = [t.encode() for t, ok in zip(texts, plain) if ok]
        found = iter(self._by_words(usual)) if usual else iter(())
        return [next(found) if ok else self.whole(t) for t, ok in zip(texts, plain)]

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """A unit is a word with the blank before it; a text begins with a unit without one."""
        data, begins = joined(texts)
        first = begins[:-1][np.diff(begins) > 1]  # an empty text has no unit
        heads = np.zeros(len(data) + 1, bool)
        heads[np.flatnonzero(data == 32)] = True
        heads[first] = True
        last = begins[1:] - 1  # the line feed after each text
        starts = np.flatnonzero(heads[:-1])
        ends = np.minimum(np.append(starts[1:], len(data)), last[np.searchsorted(last, starts)])
        ids, before = self.cache.ids(data, starts, ends)
        edges = before[np.searchsorted(starts, begins)].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that later tasks find its words."""
    return WordEncoder(path)
