import zlib
from collections import Counter, defaultdict

import pytest

from rankloom.llm import catalog
from rankloom.llm.language import learn_profiles, predict, with_language

from .helpers import CLASH, LONG, docs, prose


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + "".join(w + " " for w in words)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            part = line[i:i + n]
            if part.strip() and " " not in part[1:-1]:
                out[part] += 1
    return out


def code(gram):
    return sum(ord(c) << 16 * (len(gram) - 1 - k) for k, c in enumerate(gram))


def order(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def plain(rows, texts, size):
    sums = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            sums[lang] += grams(text)
    profiles = {lang: {g: r for r, g in enumerate(order(c, size))} for lang, c in sorted(sums.items())}
    out = []
    for text in texts:
        own = order(grams(text or ""), size)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        out.append((best, 1 - far[best] / (size * len(own))))
    return out


ROWS = [("xx", prose(i, 30)) for i in range(6)] + [("yy", "Die Straße führt über Äpfel, und der Hund läßt es. " * 2), ("yy", "ein Stück"),
                                                   ("zz", "l'été où ça va très bien"), (None, "zzz qqq"), ("zz", None), ("xx", "")]


def test_equals_a_plain_version(spark):
    learnt = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    profiles = learn_profiles(learnt)
    texts = [None, "", "123 ...", "a", "der Hund", "été", prose(50, 20), "İstanbul 𝒜𝒷 x", LONG[:50_000], "e", "e", "one\ntwo"]
    got = with_language(docs(spark, texts, **CLASH), profiles).orderBy("doc_id").collect()
    want = plain(ROWS, texts, 400)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert [r.score for r in got] == pytest.approx([w[1] for w in want])


def test_no_profiles_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert learn_profiles(none) == {}
    assert [r.lang_pred for r in with_language(docs(spark, ["abc"]), {}).collect()] == ["und"]
    assert with_language(docs(spark, []), {}).collect() == []
    assert predict([], {}) == ([], pytest.approx([]))


def test_held_out_accuracy(spark, sf_dir):
    rows = catalog.op9_rank_order_language(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)
