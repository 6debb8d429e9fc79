"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; there are at most 1 / HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE = 1 / 256


def join_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of rows with one row per key; ``size`` is the key's number of rows.

    Keys above ``share`` of ``total`` go through a broadcast (at most 1 / share rows), all others through a shuffled join whose
    largest key is then bounded; no row is dropped on either way.
    """
    limit = max(1, int(total * share))
    hot = F.col(size) > limit
    few = F.broadcast(classes.where(hot))
    mark = F.broadcast(classes.where(hot).select(key))
    rest = rows.join(mark, key, "left_anti").join(classes.where(~hot), key)
    return rows.join(few, key).unionByName(rest)
