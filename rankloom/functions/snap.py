"""Portable rounding for comparing results between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounding border. It is moved off one half so that short decimals such as
# 0.1234565, where engines disagree in the last bit, are not on a border.
BORDER = 0.4637


def snap(value: Column | str, digits: int = 6) -> Column:
    """``floor(value * 10^digits + BORDER) / 10^digits``."""
    col = F.col(value) if isinstance(value, str) else value
    scale = float(10 ** digits)
    return F.floor(col.cast("double") * scale + BORDER) / F.lit(scale)


def snap_sql(expr: str, digits: int = 6) -> str:
    """The same expression as SQL text."""
    scale = f"1e{digits}"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + {BORDER}e0) / {scale})"
