import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm.lexical_search import accumulate, search, share, terms_of

from .helpers import CLASH, LONG, ODD, docs, prose


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(rows, items, top=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in rows]
    lengths = [sum(c.values()) for _, c in counts]
    total, length = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(counts, lengths):
            m = 100 - 90 + 90 * n * total // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus():
    texts = [prose(i, random.Random(i).choice([5, 30, 200])) for i in range(120)]
    texts += ODD + [LONG, "Éa éa ÉA x1-y2 x1", "the " * 50] + [prose(4, 30)] * 15 + [f"the {prose(i, 3)} the" for i in range(200, 320)]
    items = [(i, prose(i, 12) + " THE ") for i in range(25)] + [(100, None), (101, ""), (102, "no such-term"), (3, prose(4, 8)), (103, prose(3, 900)), (None, "x1 é")]
    return texts, items


def tuples(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block_items", [512, 7])
def test_equals_a_plain_ranking(spark, block_items):
    texts, items = corpus()
    frame = docs(spark, texts, **(CLASH | {"id": "i", "n": 3, "item": 4, "number": 5, "terms": "t"})).repartition(5)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit(1))
    got = tuples(search(frame, table, block_items=block_items))
    assert got == plain_search(list(enumerate(texts)), items) and len(got) > 250


def test_ties_repeated_rows_null_and_string_ids(spark):
    texts = ["apple pie", "apple tart", "apple pie", "banana", "cherry jam", "plum", None]
    for ids, kind in (([9, 2, 2, 7, None, 1, 3], "long"), (["é", "a", "a", "z", None, "y", "x"], "string")):
        frame = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        items = spark.createDataFrame([(1, "apple cherry"), (1, "apple cherry"), (2, "banana")], "item_id long, text string")
        want = [r for r in plain_search(list(zip(ids, texts)), [(1, "apple cherry"), (2, "banana")], top=3)]
        got = tuples(search(frame, items, top=3))
        assert Counter(got) == Counter(want + [r for r in want if r[0] == 1])


def test_many_ties_keep_the_smallest_ids(spark):
    frame = docs(spark, ["same words here"] * 400 + ["other"] * 900, ids=list(range(1300, 0, -1))).repartition(6)
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r[2] for r in sorted(tuples(search(frame, items)), key=lambda r: r[1])] == list(range(901, 911))


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(docs(spark, []), items).collect() == []
    assert search(docs(spark, [None, ""]), items).collect() == []
    assert search(docs(spark, ["a b"]), items.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=12))
def test_the_graph_adds_each_term_once(items):
    graph = share(items, 31)
    values = np.array([1 << t for t in range(31)])  # a term that is left out or added twice shows in the bits
    total = accumulate(graph, np.zeros(31, int), np.arange(31), values, 1)
    assert total[:, 0].tolist() == [sum(1 << t for t in own) for own in items]


def test_shared_sets_save_additions():
    draw = random.Random(1)
    common = [set(draw.sample(range(1_000), 20)) for _ in range(5)]
    items = [set().union(*draw.sample(common, 3)) | set(draw.sample(range(1_000, 2_000), 3)) for _ in range(80)]
    graph = share(items, 2_000)
    plain = sum(len(own) - 1 for own in items)
    terms = set().union(*items)
    made = len(graph.left) + sum(np.bincount(graph.item, minlength=80) - 1) + len(terms) - len(set(graph.leaf[list(terms)].tolist()))
    assert made < plain / 5


def test_terms(spark):
    frame = spark.createDataFrame([("Don't É-x 1a_b ÄÖ don",), (None,)], "text string").select(terms_of(F.col("text")))
    assert [r[0] for r in frame.collect()] == [["don", "t", "É", "x", "1a", "b", "ÄÖ"], []]
