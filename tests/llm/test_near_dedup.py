import random
from collections import Counter

import numpy as np

from rankloom.llm.bag_minhash import multisets, signatures, weighted_jaccard
from rankloom.llm.components import components
from rankloom.llm import near_dedup
from rankloom.llm.near_dedup import BAND_ROWS, REGISTERS, SIMILAR, difference, drop_near_duplicates, near_duplicates, spanning_links

from .helpers import CLASH, LONG, ODD, docs, prose


def bag(text):
    words = (text or "").encode().split(b" ")
    words = [w for part in words for w in part.split()]
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)])


def classes(texts):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if b and a / b >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(texts))}


def edited(text, seed, edits):
    words, draw = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{seed}"
    return " ".join(words)


def test_classes_equal_all_pairs(spark):
    texts = ODD + [LONG[:30_000], LONG[:30_050]]
    for family in range(6):
        base = prose(100 + family, 120)
        texts += [base] * 3 + [edited(base, family * 50 + k, 1 + k % 5) for k in range(12)]
    texts += ["w " * n for n in (6, 7, 40, 45, 400)]  # multiplicities differ, sets are equal
    frame = docs(spark, texts, **CLASH).repartition(3)
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    result = near_duplicates(frame)
    want = classes(texts)
    assert {r.doc_id: r.class_id for r in result.collect()} == want
    assert result.filter("kept").count() == len(set(want.values()))
    out = drop_near_duplicates(frame)
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == set(want.values())


def near_threshold_class():
    """A class of 150, and 12 texts that lie at 0.796 to its members but at 0.8165 to one each.

    Words 4, 9, 14, ... can be replaced, each in five of the 396 shingles; the class and the twelve use different ones.
    """
    draw, words = random.Random(5), [f"word{i}" for i in range(400)]
    slots = list(range(4, 396, 5))
    own, far = slots[:39], slots[39:]

    def text(edits):
        return " ".join(edits.get(i, w) for i, w in enumerate(words))

    texts = [text({p: f"near{k}p{p}" for p in draw.sample(own, 2)}) for k in range(150)]
    for k in range(12):
        mine = {p: f"far{k}p{p}" for p in draw.sample(far, 7)}
        shared = draw.choice(sorted(mine))
        texts += [text({shared: mine[shared]} | {p: f"bridge{k}p{p}" for p in draw.sample(own, 2)}), text(mine)]
    return texts


def test_a_link_to_one_member_of_a_large_class_near_the_threshold(spark):
    texts = near_threshold_class()
    want = classes(texts)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()} == want


def test_repeated_rows_null_ids_empty_table(spark):
    frame = docs(spark, [prose(1, 30)] * 3 + [None, "", ""], ids=[5, 5, None, None, 7, 7])
    rows = near_duplicates(frame).collect()
    assert sorted(r.class_size for r in rows) == [1, 1, 1, 3, 3, 3] and sum(r.kept for r in rows) == 4
    assert {r.class_id for r in rows if r.class_size == 3} == {5}
    assert near_duplicates(docs(spark, [])).collect() == []
    assert drop_near_duplicates(docs(spark, [])).collect() == []


def test_registers_agree_as_often_as_multisets_are_similar():
    draw = np.random.default_rng(3)
    registers = 4_096
    for heavy in (1, 9, 1_000):
        element = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = draw.integers(0, heavy + 1, 60) + (np.arange(60) % 3 == 0), draw.integers(0, heavy + 1, 60)
        table = signatures(
            np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]), np.concatenate([element[a > 0], element[b > 0]]),
            np.concatenate([a[a > 0], b[b > 0]]), 2, registers)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((table[0] == table[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / registers) + 1e-3
        assert abs(weighted_jaccard((np.sort(element[a > 0]), a[a > 0][np.argsort(element[a > 0])]),
                                    (np.sort(element[b > 0]), b[b > 0][np.argsort(element[b > 0])])) - want) < 1e-12


def test_a_similar_pair_rarely_shares_no_bucket():
    assert (1 - SIMILAR ** BAND_ROWS) ** (REGISTERS // BAND_ROWS) < 4e-6


def family(n, seed=8):
    """Texts of 400 words, six of which are replaced at places 4, 9, 14, ...: similar by about 0.74 to each other."""
    draw, words = random.Random(seed), [f"word{i}" for i in range(400)]
    texts = []
    for k in range(n):
        own = list(words)
        for p in draw.sample(range(4, 396, 5), 6):
            own[p] = f"text{k}p{p}"
        texts.append(" ".join(own))
    return texts


def test_a_family_below_the_threshold_puts_out_no_pairs(spark, monkeypatch):
    """60 and 240 texts, nearly all single: rows out of each step grow with the texts, not with their pairs."""
    rows, real = {}, near_dedup.stage

    def counted(df, name):
        out = real(df, name)
        rows[n].setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    for n in (60, 240):
        rows[n] = {}
        texts = family(n)
        assert {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()} == classes(texts)
    for name in rows[60]:
        assert max(rows[240].get(name, [0])) <= 8 * max(*rows[60][name], 30), name  # pairs would be 16 times as many
    bands = REGISTERS // BAND_ROWS
    assert max(rows[240]["led"]) < bands * 240 and max(rows[240].get("open-links", [0])) < 240


def test_cells_of_any_size_give_the_same_classes(spark, monkeypatch):
    texts = near_threshold_class()[100:] + family(60)
    want = classes(texts)
    monkeypatch.setattr(near_dedup, "CELL_NODES", 7)
    monkeypatch.setattr(near_dedup, "TOKENS", 64)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(spark, texts)).collect()} == want


def test_differences_from_a_third_give_the_exact_distance():
    draw = np.random.default_rng(7)
    for _ in range(50):
        bags = []
        for _ in range(3):
            element = np.flatnonzero(draw.random(40) < 0.7).astype(np.uint64)
            bags.append((element, draw.integers(1, 5, len(element))))
        a, b, lead = bags
        d, e = difference(a, lead), difference(b, lead)
        assert len(np.unique(d)) == len(d)
        apart = len(d) + len(e) - 2 * len(np.intersect1d(d, e))
        both = int(a[1].sum() + b[1].sum())
        assert abs((both - apart) / (both + apart) - weighted_jaccard(a, b)) < 1e-12


def test_links_of_a_cell_are_a_forest():
    draw = np.random.default_rng(2)
    for density in (0.02, 0.1, 0.6):
        linked = draw.random((30, 50)) < density
        links = list(spanning_links(linked))
        assert all(linked[r, c] for r, c in links)

        def groups(pairs):
            parent = list(range(80))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            joined = 0
            for r, c in pairs:
                x, y = root(r), root(30 + c)
                parent[max(x, y)] = min(x, y)
                joined += x != y
            return [root(x) for x in range(80)], joined

        every, needed = groups(zip(*np.nonzero(linked)))
        assert groups(links) == (every, needed) and len(links) == needed


def test_multiset_counts():
    doc, element, count = multisets(np.array([1, 0, 1, 1]), np.array([7, 7, 7, 3], np.uint64))
    assert list(zip(doc.tolist(), element.tolist(), count.tolist())) == [(0, 7, 1), (1, 3, 1), (1, 7, 2)]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(40, 90)] + [(200, 200 + k) for k in range(1, 40)] + [(draw.randrange(300, 340), draw.randrange(300, 340)) for _ in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
