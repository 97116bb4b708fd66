"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def rounded(value: Column | str, name: str | None = None) -> Column:
    """``value`` rounded for comparison across engines, -0.0 made 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    name = name or (value if isinstance(value, str) else None)
    return (F.round(column, DIGITS) + 0.0).alias(name)


def sql_rounded(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 AS {name}"
