"""Queries of the text operators and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm.boilerplate import BLOCKS, HIDDEN, HOST, MIN_PAGES, RATIO, page_text_without_boilerplate
from rankloom.llm.common import table
from rankloom.llm.exact_dedup import exact_duplicates
from rankloom.llm.language import learn_profiles, with_language
from rankloom.llm.lexical_search import search
from rankloom.llm.mixing import mix_sources
from rankloom.llm.near_dedup import near_duplicates
from rankloom.llm.packing import pack_documents, with_checksum
from rankloom.llm.prefix_forest import nearest
from rankloom.llm.pseudonyms import pseudonymise
from rankloom.llm.sentencepiece_backend import encode_documents
from rankloom.llm.spelling import spelling_variants
from rankloom.llm.substring_dedup import remove_repeats
from rankloom.llm.toxicity import fit_severity, with_severity

#: Key of the registered queries. A production run passes its own secret.
DEMO_KEY = "rankloom-demo-key"


def op1_site_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text_without_boilerplate(table(spark, sf_dir, "pages"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY, count_col="n_replaced")


def op3_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_checksum(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("_row")


def op6_count_min_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_decoded=False)
    return coded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip", "parity")


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_row")


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    profiles = learn_profiles(docs.filter(rest != 2))
    found = with_language(docs, profiles)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_severity(docs, table(spark, sf_dir, "labels"))
    scored = with_severity(docs, model, chance_col="toxic_chance")
    return scored.select("doc_id", "severity", "toxic_chance", (scored.severity >= 0.5).alias("rejected"))


def op11_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op12_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_shared_subexpressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_site_boilerplate": op1_site_boilerplate,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_min_slack_packing": op3_min_slack_packing,
    "op4_prefix_forest": op4_prefix_forest,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_count_min_passages": op6_count_min_passages,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_bag_minhash": op8_bag_minhash,
    "op9_rank_order_language": op9_rank_order_language,
    "op10_toxic_severity": op10_toxic_severity,
    "op11_entropy_balancing": op11_entropy_balancing,
    "op12_pivotal_grams": op12_pivotal_grams,
    "op13_shared_subexpressions": op13_shared_subexpressions,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op13_shared_subexpressions": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (
  SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
corpus AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM d WHERE len(ts) > 0),
wanted AS (SELECT qid, item_id, unnest(ts) AS term FROM q),
terms AS (SELECT rid, unnest(ts) AS term FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM terms SEMI JOIN wanted USING (term) GROUP BY rid, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term),
parts AS (
  SELECT tf.rid, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * docs) // length))) AS part
  FROM tf JOIN weights ON tf.term = weights.term JOIN d ON tf.rid = d.rid, corpus),
scores AS (
  SELECT qid, item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts ON wanted.term = parts.term
  GROUP BY qid, item_id, rid, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores) WHERE rank <= 10
""",
    "op12_pivotal_grams": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
counted AS (
  SELECT run, length(run) AS size, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
marked AS (
  SELECT run, size, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(len(digits) // 2), lambda i:
    16 * (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, struct_pack(a := -m, b := near)) AS near, max(m) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN m >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, word AS root, 0 AS far FROM forms
  UNION ALL SELECT c.word, f.form, far + 1 FROM chains c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, far) AS root FROM chains GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON f.word = r.word
""",
    "op6_count_min_passages": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS j, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS seq
  FROM d WHERE len(ws) >= 35),
flags AS (SELECT rid, j, count(*) OVER (PARTITION BY seq) > 1 AS again FROM starts),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
marked AS (
  SELECT w.rid, w.j, word, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (
    PARTITION BY w.rid ORDER BY w.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM words w LEFT JOIN flags f ON w.rid = f.rid AND w.j = f.j),
kept AS (
  SELECT rid, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS t
  FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid
""",
    "op1_site_boilerplate": rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{HIDDEN[0]}', '', 'g'), '{HIDDEN[1]}', '', 'g'), '{HIDDEN[2]}', '', 'g'),
      '(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM p WHERE host IS NOT NULL GROUP BY host),
seen AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL),
flagged AS (
  SELECT s.host, list(s.line) AS dropped FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) s
  JOIN totals t ON s.host = t.host WHERE n >= {MIN_PAGES} AND n / host_pages > {RATIO} GROUP BY s.host),
kept AS (SELECT p.*, host_pages, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS own
  FROM p LEFT JOIN totals t ON p.host = t.host LEFT JOIN flagged f ON p.host = f.host)
SELECT page_id, host, host_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(own) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(own, chr(10)), '') AS text
FROM kept
""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
""",
}
