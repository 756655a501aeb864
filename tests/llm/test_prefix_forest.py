import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import catalog
from rankloom.llm.prefix_forest import bits_of, hash_strings, nearest, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, ask, k=5):
    out = {}
    for i, (name, vector) in enumerate(rows):
        if ask(name):
            a = np.array(vector, float)
            scored = []
            for j, (other, w) in enumerate(rows):
                if i != j and len(w) == len(vector):
                    b = np.array(w, float)
                    scored.append((-(a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()), other))
            out.setdefault(name, []).append([(o, -s) for s, o in sorted(scored)[:k]])
    return out


def same(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == {q for q, lists in want.items() if lists[0]}
    for q, pairs in found.items():
        assert [i for i, _ in pairs] == [i for i, _ in want[q][0]]
        assert np.allclose([s for _, s in pairs], [s for _, s in want[q][0]], atol=1e-12)


def test_searching_all_is_exact_with_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (305, [1.0, 0.0, 0.0])]
    odd = [(400, None), (405, []), (410, [0.0] * 8), (415, [float("nan")] + [1.0] * 7), (420, [float("inf")] + [1.0] * 7), (425, [None] + [1.0] * 7)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumn("row", F.lit(1)).withColumn("score", F.lit("s"))
    got = nearest(frame, F.col("vec_id") % 5 == 0, enough=10 ** 6).collect()
    same(got, brute(rows, lambda i: i % 5 == 0))
    small = nearest(frame, F.col("vec_id") % 5 == 0, enough=10 ** 6, shard_rows=16, query_rows=7).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))


def test_repeated_rows_null_ids_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (1, 2, 2)]
    assert nearest(spark.createDataFrame(rows, SCHEMA), F.lit(None).cast("boolean")).collect() == []
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 1).collect() == []


def test_ascent_stops_at_the_longest_common_level():
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(300, 16))
    bits, symbols = bits_of(16, 3)
    codes = hash_strings(vectors, 8, 3)
    for q, found in enumerate(search(codes, codes[:20], bits * symbols, 60)):
        for up in range(bits * symbols + 1):
            match = codes >> up == codes[q] >> up
            if match.sum() >= 60:
                break
        assert found.tolist() == np.flatnonzero(match.any(axis=1)).tolist()


def test_recall_on_the_test_vectors(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    vectors, ids = np.array([r.embedding for r in table], float), [r.vec_id for r in table]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    got = {}
    for r in catalog.op4_prefix_forest(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i, name in enumerate(ids):
        if name % 50 == 0:
            score = vectors @ vectors[i]
            score[i] = -2
            want = {ids[j] for j in np.argsort(-score, kind="stable")[:5]}
            hits, total = hits + len(want & got[name]), total + 5
    assert hits / total >= 0.9
