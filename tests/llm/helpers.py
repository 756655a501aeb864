"""Small tables with the odd cases that every operator must handle."""

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(words))


def docs(spark, texts, ids=None, **extra):
    """doc_id, text and whatever columns a caller may have; ``extra`` maps a column name to a constant."""
    rows = list(zip(ids if ids is not None else range(len(texts)), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Columns that an operator might use inside, as columns of the caller.
CLASH = {"row": "r", "_row": 1, "key": "k", "node": 2.5, "size": 3, "word": "w", "host": "h", "kept": "x", "_bytes": "b", "score": "s"}
ODD = [None, "", " \t\n", "x", "one two three four", prose(1, 60), prose(1, 60), prose(2, 60), "é😀 ü", None, ""]
LONG = prose(3, 60_000)
