"""Joining a value of each key back to the rows of that key, however unevenly keys are shared.

A key of very many rows (over HOT, or one in MOST_HOT of all rows, whichever is
more) would bring them all into one task of an equi-join. At most MOST_HOT keys
can be so frequent, whatever the number of rows; their values are broadcast to
the rows. All other keys meet in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT, MOST_HOT = 1000, 10_000


def is_hot(n: str, n_rows: int) -> Column:
    return F.col(n) > max(HOT, n_rows // MOST_HOT)


def back_to_rows(rows: DataFrame, values: DataFrame, key: str, n: str, n_rows: int) -> DataFrame:
    """`rows` with the columns of `values` (key, n: the rows of this key, …; one row a key) but n; rows whose key is null or has no value are left out."""
    hot = is_hot(n, n_rows)
    frequent = F.broadcast(values.where(hot).drop(n))
    many = rows.join(frequent, key)
    few = rows.join(frequent.select(key), key, "left_anti").join(values.where(~hot).drop(n), key)
    return many.unionByName(few)
