"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000  # that are sent to all tasks; more are joined


def small(df: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has few rows, which are counted up to the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
