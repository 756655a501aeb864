"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of ``docs``. A runner writes each stage's rows as Parquet and reads them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import stage, table
from rankloom.llm.exact_dedup import drop_exact_duplicates
from rankloom.llm.near_dedup import drop_near_duplicates
from rankloom.llm.packing import pack_documents, with_checksum
from rankloom.llm.pseudonyms import pseudonymise
from rankloom.llm.toxicity import fit_severity, reject_toxic

#: Key of the pseudonyms. A production run passes its own secret.
PII_KEY = "rankloom-demo-key"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is at least 0.5 go."""
    return reject_toxic(docs, fit_severity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; no document goes."""
    return pseudonymise(docs, PII_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the checksum of their ids."""
    return with_checksum(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: The toxicity model and the signatures have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
