"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import stage_folder

#: White space of the text contracts: blank and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()

#: A table with at most this many narrow rows may be broadcast (about 20 MB).
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and keeps column pruning."""
    path = stage_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``staged`` with a broadcast hint when its counted rows are within ``rows``; else as it is.

    The caller passes a staged table with fixed-width columns, so the count bounds the bytes
    and costs a footer read. Above the bound the join shuffles and AQE splits hot keys.
    """
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
