"""Joins of many rows with one row a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this part of all rows, so there are never more hot keys than this.
MOST = 2000


def hot_keys(counted: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """The hot ones of counted (keys, n), at most MOST rows."""
    return counted.where(F.col(n) * F.lit(MOST) >= F.lit(total)).select(*keys)


def attached(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows with values (one row a key), as a left join; keys aren't null.

    Rows of hot keys meet their values by a broadcast of at most MOST rows and stay where they are; only the others
    are shuffled by key.
    """
    few = F.broadcast(hot.join(values, keys, "left"))
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(values, keys, "left")
    return rows.join(few, keys).unionByName(rest)
