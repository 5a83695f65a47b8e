"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.session import durable

HOT_ROWS = 5_000_000
HOT_KEYS = 10_000  # most keys that are ever broadcast


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], hot_rows: int | None = None) -> DataFrame:
    """Inner join with a table that has one row per key and, in `n`, how many rows of `left` carry the key.

    Keys of more than `hot_rows` rows (HOT_ROWS by default), and of more than one HOT_KEYS-th of all, are joined by broadcast: there
    can be at most HOT_KEYS of them. All other keys are joined by shuffle, where no key is then larger than one comfortable
    partition. `right` should be durable: it is read up to three times.
    """
    keys = [key] if isinstance(key, str) else key
    most = right.agg(F.max("n").alias("n"), F.sum("n").alias("total")).first()
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, (most.total or 0) // HOT_KEYS)
    if (most.n or 0) <= limit:
        return left.join(right, keys)
    hot = F.broadcast(right.filter(F.col("n") > limit))
    cold = right.filter(F.col("n") <= limit)
    rest = left.join(F.broadcast(right.filter(F.col("n") > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(cold, keys))


def join_measured(left: DataFrame, right: DataFrame, key: str | list[str], hot_rows: int | None = None) -> DataFrame:
    """`join_counted` with the rows a key has in `left` counted first, by an aggregate that combines before its shuffle."""
    keys = [key] if isinstance(key, str) else key
    counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    return join_counted(left, durable(right.join(counts, keys)), keys, hot_rows).drop("n")
