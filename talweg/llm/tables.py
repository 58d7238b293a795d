"""Joins by keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than this share of all rows, so there are at most as many frequent keys.
SHARES = 4096


def join_counted(rows: DataFrame, keys: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has one row for each value of ``key`` and how many rows have it.

    Values with more than a 4096th of ``total`` rows are joined by a broadcast of at most 4096 of them, where the rows
    lie; only the others are shuffled, so no task gets a frequent key's rows."""
    hot = F.col(count) * SHARES > F.lit(total)
    few = F.broadcast(keys.filter(hot))
    rest = rows.join(F.broadcast(keys.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(keys.filter(~hot), key))
