"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000


def hot_keys(df: DataFrame, key: str, rows: int, share: float = HOT_SHARE, floor: int = 50_000) -> list:
    """Values of ``key`` with more than max(floor, share * rows) rows; at most 1/share values.

    The count combines on the map side, so a hot key reaches its reducer as one row per task.
    """
    limit = max(floor, int(rows * share))
    if rows <= limit:
        return []
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in n.where(F.col("_n") > limit).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key``.

    Rows of ``left`` under a hot key meet their row of ``right`` by broadcast (at most
    ``len(hot)`` rows, itself bounded by ``hot_keys``); the others are shuffled on the key.
    ``how``: inner, left, left_semi or left_anti.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = left.where(~is_hot).join(right.where(~is_hot), key, how)
    b = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return a.unionByName(b)
