import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm.packing import _Packer, best_fill, fill_windows, pack_documents, with_checksum
from rankloom.llm.tokens import word_encoder

from .helpers import CLASH, LONG, ODD, docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(items, capacity):
    best = 0
    for n in range(len(items) + 1):
        for some in combinations(items, n):
            if best < sum(some) <= capacity:
                best = sum(some)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_fill_is_the_best_subset_sum_within_the_counts(seed):
    draw = random.Random(seed)
    items = [draw.randrange(1, 30) for _ in range(draw.randrange(0, 11))]
    capacity = draw.randrange(1, 90)
    used = best_fill(Counter(items), capacity)
    assert sum(k * n for k, n in used.items()) == brute(items, capacity)
    assert not used - Counter(items)


def test_plan_uses_every_piece_once():
    draw = random.Random(1)
    counts = Counter(draw.randrange(1, 64) for _ in range(500))
    left = counts.copy()
    total = Counter()
    for pattern, times in fill_windows(left, 64, 1):
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            total[k] += n * times
    assert total == counts and not left


def test_a_length_without_completion_does_not_end_the_plan():
    counts = Counter({1020: 1, 1000: 1, 600: 10, 424: 9, 24: 2})
    plan = fill_windows(counts, 1024, 1024)
    assert sorted((sorted(p.elements()), n) for p, n in plan) == [([24, 1000], 1), ([424, 600], 9)]
    assert counts == {1020: 1, 600: 1, 24: 1}


def test_no_full_window_can_be_made_of_what_is_left():
    for seed in range(30):
        draw = random.Random(seed)
        counts = Counter(draw.randrange(1, 40) for _ in range(draw.randrange(1, 14)))
        fill_windows(counts, 40, 40)
        assert brute(list(counts.elements()), 40) < 40


def test_most_remainders_are_placed_whole():
    draw = random.Random(4)
    lengths = [min(4_000, int(draw.lognormvariate(5.6, 1.0)) + 1) for _ in range(3_000)]
    packer = _Packer(0, 1024, 1_000, 1024)
    for i, n in enumerate(lengths):
        packer.add(i, np.zeros(n, np.uint32))
    packer.finish()
    pieces = Counter(row[0] for row in packer.out)
    cut = sum(pieces[i] > -(-n // 1024) for i, n in enumerate(lengths))
    assert cut < 0.05 * len(lengths)
    assert len({row[5] for row in packer.out}) == -(-sum(lengths) // 1024)


@pytest.mark.parametrize("capacity,pool", [(1024, 8192), (64, 40), (7, 5)])
def test_pieces_cover_documents_and_fill_sequences(spark, capacity, pool):
    texts = ODD + [prose(i, 5 + i * 7 % 400) for i in range(150)] + [LONG[:40_000], " two  blanks ", "a\n \nb", "don 't", "x <|endoftext|> y"]
    frame = docs(spark, texts, **CLASH).repartition(3)
    rows = pack_documents(frame, PATH, capacity=capacity, pool=pool).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    for i, ids in want.items():
        got = sorted(pieces[i])
        assert [x for _, part, _ in got for x in part] == ids
        assert [s for s, _, _ in got] == np.cumsum([0, *[len(p) for _, p, _ in got[:-1]]]).tolist()
        assert {n for _, _, n in got} == {len(ids)}
    unfilled = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        unfilled += at < capacity
    assert unfilled <= 4  # one a task


def test_checksum_empty_table_repeated_rows(spark):
    frame = docs(spark, ["ab cd", "ab cd", None], ids=[1, 1, None])
    rows = with_checksum(pack_documents(frame, PATH)).collect()
    ids = [*Tokenizer.from_file(PATH).encode("ab cd", add_special_tokens=False).ids, 0]
    assert sorted(r.ids_crc32 for r in rows if r.doc_id == 1) == [zlib.crc32(np.array(ids, "<u4").tobytes())] * 2
    assert [r.length for r in rows if r.doc_id is None] == [1]
    assert pack_documents(docs(spark, []), PATH).collect() == []
    assert rows[0].sequence_id is not None and frame.select(F.count("*")).first()[0] == 3


def test_word_encoder_equals_the_tokenizer():
    texts = ["", " ", "  ", "a", " lead", "trail ", "x.\n y", "\n\n w", "a\n \nb", "don 't it's", "é  \t x", "\x1c a \x85b 　c", "ö!?", "abc... 'll", "naïve-",
             "x .", "a <|endoftext|> b", "१२ ab३ ½", "ᄀ가 ﬁ́a", "word*** $$$ a#b", "🙂 🙂🙂", "a\x00b"]
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, word_encoder(PATH)(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
