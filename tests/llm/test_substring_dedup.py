import re
from collections import Counter

import pytest

from rankloom.llm.substring_dedup import remove_repeats

from .helpers import CLASH, LONG, ODD, docs, prose


def plain(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("size,log2_cells", [(35, 20), (35, 4), (8, 16), (12, 10)])
def test_equals_a_plain_count(spark, size, log2_cells):
    shared, other = prose(77, 60), prose(78, 40)
    texts = ODD + [prose(i, 30) + " " + shared[i * 3:].partition(" ")[2] + "\n" + prose(i + 50, 20) for i in range(12)]
    texts += [other + " " + other, "again " * 90, "a b c d e " * 30, other.replace(" ", "\t\r\n "), LONG[:60_000], prose(5, 34), prose(5, 35), prose(5, 35) + " end", "  " + prose(6, 36) + " "]
    frame = docs(spark, texts, **CLASH).repartition(3)
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame, size=size, log2_cells=log2_cells).collect()}
    want = plain(texts, size)
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)


def test_repeated_rows_empty_table_small_size(spark):
    frame = docs(spark, [prose(1, 50), prose(1, 50), None], ids=[1, 1, None])
    rows = remove_repeats(frame, log2_cells=10).collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in rows if r.doc_id == 1] == [(50, 50, "")] * 2
    assert remove_repeats(docs(spark, []), log2_cells=10).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(frame, size=7)
