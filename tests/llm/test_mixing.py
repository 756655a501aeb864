import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm.mixing import mix_sources, mixed_documents, whole_copies

from .helpers import CLASH, LONG, ODD, docs, prose


def plain_targets(words, limit=3):
    """Shares by weight; what lies above the limit is shared again."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, free = {}, sum(words.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > limit * words[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = limit * words[s]
            rest -= target[s]
            free.discard(s)
    return target


def plain_rates(sizes, target, limit=3):
    """The multiplier by plain bisection."""
    mean, low, high = sum(sizes) / len(sizes), -1e4, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        taken = sum(s * math.exp(min(middle * s / mean, math.log(limit))) for s in sizes)
        low, high = (middle, high) if taken < target else (low, middle)
    return [math.exp(min(low * s / mean, math.log(limit))) for s in sizes]


def corpus():
    draw, rows = random.Random(4), []
    for k, n in enumerate([200, 60, 30, 30, 15, 3]):
        rows += [(prose(1000 * k + i, int(draw.lognormvariate(3, 1)) + 1), f"src{k}") for i in range(n)]
    rows += [(t, None) for t in ODD] + [(prose(7, 20), "src0")] * 90 + [(LONG, "é long"), (None, "empty")]
    return rows


def frame_of(spark, rows, parts=3):
    df = docs(spark, [t for t, _ in rows], **{k: v for k, v in CLASH.items() if k != "size"})
    own = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "doc_id long, source string")
    return df.join(own, "doc_id").repartition(parts)


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_targets_rates_and_copies(spark, slice_rows):
    rows = corpus()
    got = {r.doc_id: r for r in mix_sources(frame_of(spark, rows), slice_rows=slice_rows).collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, _ in rows]
    words, members = Counter(), defaultdict(list)
    for i, (_, s) in enumerate(rows):
        words[s] += size[i]
        members[s].append(i)
    target = plain_targets(words)
    assert len(got) == len(rows)
    for s, ids in members.items():
        assert all(got[i].size == size[i] and got[i].source_size == words[s] for i in ids)
        assert all(abs(got[i].target - target[s]) <= 1e-9 * max(target[s], 1) for i in ids)
        own = [i for i in ids if size[i]]
        assert all(got[i].taken == 0 and got[i].rate is None for i in ids if not size[i])
        if not own:
            continue
        if target[s] < 3 * words[s]:
            want = plain_rates([size[i] for i in own], target[s])
            assert np.allclose([got[i].rate for i in own], want, rtol=1e-6)
        taken = sum(got[i].taken for i in own)
        assert abs(taken - target[s]) <= max(size[i] for i in own) / 2 + 1e-6
        if len(own) > 20:
            assert abs(taken - target[s]) <= 0.5 * min(size[i] for i in own) + 1e-6
        assert all(got[i].taken == got[i].copies * size[i] and 0 <= got[i].copies <= 3 for i in own)
        for a in own:  # documents of one class differ by one copy at most
            assert all(abs(got[a].copies - got[b].copies) <= 1 for b in own if size[a] == size[b])


def test_reruns_agree_on_other_partitions(spark):
    rows = corpus()
    one, two = (sorted(map(tuple, mix_sources(frame_of(spark, rows, p)).collect()), key=str) for p in (1, 7))
    assert one == two


def test_the_mix_repeats_whole_rows(spark):
    frame = frame_of(spark, corpus()).withColumnRenamed("row", "_mix_row")
    copies = {r.doc_id: r.copies for r in mix_sources(frame).collect()}
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_repeated_rows_null_ids_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c d e", "y"), (2, None, "y"), (3, "", None)], "doc_id long, text string, source string")
    rows = mix_sources(frame).collect()
    assert len(rows) == 5 and sum(r.taken for r in rows) <= 3 * 7
    assert {(r.doc_id, r.size, r.source_size) for r in rows} == {(1, 2, 4), (None, 3, 3), (2, 0, 3), (3, 0, 0)}
    assert mix_sources(frame.limit(0)).collect() == []
    assert mixed_documents(frame.limit(0)).collect() == []
    silent = mix_sources(frame.filter("doc_id in (2, 3)")).collect()
    assert [(r.size, r.target, r.taken) for r in silent] == [(0, 0.0, 0)] * 2
    named = spark.createDataFrame([("p", "a b c", "x"), ("q", "a", "y")], "doc_id string, text string, source string")
    assert mix_sources(named).count() == 2


def test_carried_rounding_stays_within_half_a_text():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = np.unique(np.concatenate([np.arange(1, 20), rng.integers(20, 4_000, 200)]))[::-1].astype(np.int64)
        n, rate = rng.integers(1, 9, len(size)), rng.uniform(0.5, 2.5, len(size))
        target = float((n * rate * size).sum())
        copies = whole_copies(size, n, rate, target, 3)
        assert (copies >= 0).all() and (copies <= 3 * n).all()
        assert abs(float((copies * size).sum()) - target) <= 1
