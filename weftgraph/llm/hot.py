"""Joins whose hot keys are split off and broadcast; at most ``SHARE`` keys can be hot, by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many of all rows; so no more than so many keys are.
SHARE = 500


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with ``groups`` (one row a key, ``count``: rows that hold it), rows of hot keys without moving them."""
    hot = F.broadcast(groups.where(F.col(count) * SHARE > F.lit(total)))
    cold = groups.where(F.col(count) * SHARE <= F.lit(total))
    return rows.join(hot, key, how).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))
