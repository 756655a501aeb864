import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, radix_leaders

from .helpers import CLASH, LONG, ODD, docs, prose


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        out.append((i, min(groups[norm])[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_classes_equal_a_plain_grouping(spark):
    base = prose(9, 400)
    variants = [base, base.replace(" ", "\n"), base[:-1], base + "z", "q" + base[1:], base + "  ", base[:300] + "Z" + base[301:]]
    texts = ODD + variants * 3 + [LONG, LONG + " ", LONG[:-1], "0123456789abcdef", "0123456789abcde f", "0123456789abcdefg"]
    df = docs(spark, texts, **CLASH).repartition(3)
    df = spark.createDataFrame(df.collect(), df.schema)
    result = exact_duplicates(df)
    assert got(result) == expected([(r.doc_id, r.text) for r in df.collect()])
    kept = [r.doc_id for r in result.filter("kept").collect()]
    assert len(kept) == len(set(e[1] for e in expected(list(enumerate(texts)))))


def test_repeated_rows_and_null_ids_keep_one(spark):
    df = docs(spark, ["a b", "ab", "ab", "c", "c"], ids=[None, 4, 4, None, None])
    result = exact_duplicates(df).collect()
    assert sum(r.kept for r in result) == 2
    assert {r.keep_id for r in result if r.group_size == 3} == {None}  # "a b" has the most code points
    out = drop_exact_duplicates(df.withColumn("extra", df.doc_id))
    assert out.columns == ["doc_id", "text", "extra"] and out.count() == 2


def test_ids_of_text_and_a_caller_with_the_same_column(spark):
    rows = [("b", "x y"), ("a", "xy "), (None, "xy "), ("c", "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("_exact_dedup_row", F.lit(7))
    df = spark.createDataFrame(df.collect(), df.schema)
    assert {r.keep_id for r in exact_duplicates(df).collect()} == {"a", "c"}
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns and sorted((r.doc_id, r._exact_dedup_row) for r in out.collect()) == [("a", 7), ("c", 7)]


def test_a_hot_long_text_is_counted_before_it_travels(spark, monkeypatch):
    """Copies in every partition, texts that part only in late blocks; no window holds a group."""
    monkeypatch.setattr("rankloom.llm.exact_dedup.BLOCK_BYTES", 32)
    base = prose(3, 700)
    texts = [base] * 90 + [base[:-1] + "q"] * 2 + [base[:2000] + "#" + base[2001:]] * 3 + [prose(i, 20) for i in range(40)]
    df = docs(spark, texts).repartition(12, "doc_id")
    df = spark.createDataFrame(df.collect(), df.schema).repartition(12).checkpoint()
    result = exact_duplicates(df)
    assert got(result) == expected([(r.doc_id, r.text) for r in df.collect()])
    assert "Window" not in result._jdf.queryExecution().toString()


def test_empty_table(spark):
    assert exact_duplicates(docs(spark, [])).collect() == []
    assert drop_exact_duplicates(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b * 9), max_size=20), st.integers(1, 5))
def test_radix_recursion(texts, block):
    assert radix_leaders(texts, block) == [texts.index(t) for t in texts]
