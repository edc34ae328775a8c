"""How many tasks rows are dealt to: by how many rows there are, so that what one task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 250_000  # of one task


def parts(stored: DataFrame, most: int = ROWS) -> int:
    """A number of partitions in which the rows of a stored table, which are counted without reading a column, are at most about `most` each; all cores have one at least."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // most))


def dealt(stored: DataFrame, *keys: str, most: int = ROWS) -> DataFrame:
    """A stored table, the rows of one key in one place.

    What is made of a row before the next exchange is made there, so a small
    file whose rows become many is no work of one task only; and what is
    grouped by the keys needs no other exchange.
    """
    return stored.repartition(parts(stored, most), *keys)
