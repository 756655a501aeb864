import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.spelling import _bigrams, _checksums, _letters, count_words, near_words, pivots, spelling_variants

from .helpers import CLASH, LONG, ODD, docs


def plain_words(rows, min_points=6, min_count=5, erased=199):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % erased == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_points:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= min_count}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [(-words[v], v) for v in words if one_apart(w, v)]
        best = min(near) if near else None
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def vocabulary(seed=2):
    draw, words = random.Random(seed), {}
    for _ in range(70):
        base = "".join(draw.choice("abcdeéÀ") for _ in range(draw.randrange(6, 12)))
        n = draw.choice([400, 80, 20])
        words[base] = n
        for _ in range(draw.randrange(0, 14)):
            at, kind = draw.randrange(len(base)), draw.randrange(3)
            base_after = base[:at] + (draw.choice("abcdeÿ") if kind else "") + base[at + (kind != 2):]
            if len(base_after) >= 6:
                words.setdefault(base_after, draw.choice([5, 6, 15, 16, 90]))
            if draw.random() < 0.3:
                base = base_after if len(base_after) >= 6 else base
    words |= {"a" * n: n for n in range(6, 30)} | {"ab" * n: 7 for n in range(3, 9)}
    return words


def test_pairs_equal_all_pairs(spark):
    for seed in (1, 2):
        words = vocabulary(seed)
        want = {(a, b) for a in words for b in words if a < b and one_apart(a, b)}
        frame = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
        got = near_words(spark.createDataFrame(frame.collect(), frame.schema)).collect()
        assert len(got) == len(want) > 100 and {(r.a, r.b) for r in got} == want
        assert all(r.n_a == words[r.a] and r.n_b == words[r.b] for r in got)


def corpus():
    draw, texts = random.Random(9), []
    tokens = [w for w, n in vocabulary().items() for _ in range(n)]
    draw.shuffle(tokens)
    for i in range(0, len(tokens), 60):
        texts.append(draw.choice([" ", ", ", "\n", "-1-"]).join(t.upper() if draw.random() < 0.1 else t for t in tokens[i:i + 60]))
    return texts + ODD + [LONG, "x" * 50_000, " ".join(["q" * 70_000] * 6), "Straße Straße straße STRAßE straße ×÷×÷×÷"]


@pytest.mark.parametrize("erased", [199, 3])
def test_variants_equal_plain_version(spark, erased):
    texts = corpus()
    frame = docs(spark, texts, **(CLASH | {"n": 1, "form": "f"}))
    rows = spelling_variants(frame.repartition(3), erased=erased).collect()
    want = plain_variants(plain_words(list(enumerate(texts)), erased=erased))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
    assert any(row[0] and row[1] != row[0] for row in want.values())  # a chain of two forms


def test_null_ids_repeated_rows_empty_table(spark):
    frame = docs(spark, ["misspelled mispelled"] * 6 + [None, ""], ids=[None] * 3 + [7] * 3 + [1, 1])
    rows = [(i, t) for i, t in zip([None] * 3 + [7] * 3, ["misspelled mispelled"] * 6)]
    assert {r.word: r.n for r in count_words(frame, erased=2).collect()} == plain_words(rows, erased=2)
    assert spelling_variants(docs(spark, [])).collect() == []
    assert spelling_variants(docs(spark, [None, "", "one two"])).collect() == []
    named = spark.createDataFrame([("p", "letters " * 5), ("q", "letter " * 30)], "doc_id string, text string")
    assert {r.word: r.form for r in spelling_variants(named, erased=1 << 31).collect()} == {"letters": "letter", "letter": None}
    with pytest.raises(ValueError):
        spelling_variants(frame, min_points=3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 50)), min_size=3, max_size=9))
def test_pivots_are_the_lightest_disjoint_pair(steps):
    place, weight = np.cumsum([s for s, _ in steps]), np.array([w for _, w in steps])
    a, b = pivots(np.zeros(len(place), int), place, weight, 1)
    best = min(weight[i] + weight[j] for i in range(len(place)) for j in range(i) if place[i] - place[j] >= 2)
    assert place[b[0]] - place[a[0]] >= 2 and weight[a[0]] + weight[b[0]] == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.binary(max_size=64)), min_size=1, max_size=5))
def test_checksums_of_joined_bytes(parts):
    heads = [f"{i}:".encode() for i, _ in parts]
    got = _checksums(heads, np.arange(len(parts)), np.array([len(t) for _, t in parts]), np.array([crc32(t) for _, t in parts], np.uint32))
    assert got.tolist() == [crc32(h + t) for h, (_, t) in zip(heads, parts)]


def test_bigrams_stay_inside_words():
    words = ["abc", "éa"]
    word, place, gram = _bigrams(*_letters(words))
    found = defaultdict(list)
    for w, g in zip(word.tolist(), gram.tolist()):
        found[w].append(g)
    e = 0xE9 - 0xC0 + 26
    assert dict(found) == {0: [1, 1 * 90 + 2], 1: [e * 90]} and place.tolist() == [0, 1, 3]
