"""SentencePiece models run by the tokenizers library.

The model file is a protocol buffer; the few fields that are needed are read from its wire format. From
them the parts are rebuilt: the normaliser (its character map, blank handling and dummy prefix), the
metaspace marker in place of blanks, scores (unigram) or merges in order of score (BPE), and bytes for what
has no piece. Encoding and decoding are the library's. Where no piece has a marker behind another sign,
nothing is merged across the start of a word, so a text is encoded word by word, every new word once.

``parity`` runs the sentencepiece library over the same texts and compares all ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, normalizers
from tokenizers.models import BPE, Unigram

from rankloom.llm.common import text_or_empty
from rankloom.llm.wordcache import WordCache
from rankloom.llm.wordhash import chunks, joined

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values of the format
IS_UNIGRAM, IS_BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message; 32- and 64-bit values come as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind} is not known")
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = IS_UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    """Pieces (text, score, type), trainer and normaliser settings of a model file."""
    model = Model([])
    for field, value in wire_fields(data):
        if field == 1:
            part = dict(wire_fields(value))
            score = np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]
            model.pieces.append((part.get(1, b"").decode(), float(score), part.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(wire_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, IS_UNIGRAM), bool(trainer.get(35, 0))
        elif field == 3:
            rules = dict(wire_fields(value))
            model.char_map = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (IS_UNIGRAM, IS_BPE):
        raise ValueError("only unigram and BPE models are supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every pair of pieces that joins to a piece, best score first."""
    vocab = {p for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    ranked = sorted((-score, i, p) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) and len(p) > 1)
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]


def normalizer(model: Model) -> normalizers.Normalizer:
    """What happens to a text before it meets the pieces; the dummy prefix is added by the caller."""
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    return normalizers.Sequence(steps)


def build(model: Model) -> Tokenizer:
    """A tokenizer over normalised texts with markers in place of blanks."""
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == IS_UNIGRAM:
        core = Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), byte_fallback=model.byte_fallback, fuse_unk=True,
                   unk_token=None if unknown is None else model.pieces[unknown][0])
    tokenizer = Tokenizer(core)
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    # the metaspace decoder swaps the marker as Replace does, without a pattern search in every piece
    tokenizer.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse(), *last])
    return tokenizer


class PieceCodec:
    """Encodes and decodes batches of texts; ``threads`` is the library's pool in this process."""

    def __init__(self, path: str | None = None, data: bytes | None = None, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        self.data, self.model = data, parse(data)
        self.tokenizer, self.normalizer = build(self.model), normalizer(self.model)
        self.plain = not self.model.char_map and not self.model.squeeze
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
        self.cache = WordCache(self._learn)

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode().replace(" ", MARK) for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def normalised(self, text: str) -> str:
        """The text with blanks (not markers), as the pieces meet it; empty stays empty."""
        text = text if self.plain else self.normalizer.normalize_str(text)
        return f" {text}".replace(MARK, " ") if text and self.model.dummy_prefix else text.replace(MARK, " ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ready = [self.normalised(t).encode() for t in texts]
        if not self.by_word:
            return [np.array(x, np.uint32) for x in self._learn(ready)]
        data, begins = joined(ready)
        blank = data == 32
        heads = blank & ~np.concatenate([[False], blank[:-1]])
        heads[begins[:-1][np.diff(begins) > 1]] = True  # an empty text has no word
        last = begins[1:] - 1
        starts = np.flatnonzero(heads)
        ends = np.minimum(np.append(starts[1:], len(data)), last[np.searchsorted(last, starts)])
        ids, before = self.cache.ids(data, starts, ends)
        edges = before[np.searchsorted(starts, begins)].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[np.ndarray] | list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(_lists(ids), skip_special_tokens=False)

    def parity(self, texts: list[str], ids: list[np.ndarray] | list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids."""
        from sentencepiece import SentencePieceProcessor

        if not hasattr(self, "reference"):
            self.reference = SentencePieceProcessor(model_proto=self.data)
        return [a == b for a, b in zip(_lists(ids), self.reference.encode(texts, num_threads=1))]


def _lists(ids: list[np.ndarray] | list[list[int]]) -> list[list[int]]:
    return [x if isinstance(x, list) else x.tolist() for x in ids]


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> PieceCodec:
    """One codec a worker process, so that later tasks find its words."""
    return PieceCodec(path, threads=threads)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: bool = True,
                     keep_decoded: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, ids (little-endian unsigned 32-bit), decoded, round_trip, parity.

    ``decoded`` is the text that the ids stand for (null without ``keep_decoded``); ``round_trip`` says whether it
    is the text that came in (a null one counts as empty), ``parity`` says whether the sentencepiece library agrees (null
    without ``verify``). A null or empty text has no ids and decodes to an empty one. Repeated rows are encoded alike; long texts are read
    whole, and about 4 MB of text are held at a time. Other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model_path, threads)
        for batch in batches:
            for begin, end, texts in chunks(batch.column(1)):
                part = [t.decode() for t in texts]
                ids = work.encode(part)
                lists = _lists(ids)  # both libraries take Python numbers; made once
                decoded = work.decode(lists)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(decoded if keep_decoded else [None] * len(part), pa.string()),
                    pa.array([a == b for a, b in zip(decoded, part)], pa.bool_()),
                    pa.array(work.parity(part, lists) if verify else [None] * len(part), pa.bool_()),
                ], [id_col, "n_tokens", "ids", "decoded", "round_trip", "parity"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string, round_trip boolean, parity boolean")
