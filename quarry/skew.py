"""Joins of many rows with one row per key that no frequent key can bring down.

A key that many rows name would send them all to one task of a shuffled join. Keys with at least ``rows / HOT_KEYS`` rows
are at most ``HOT_KEYS``, whatever the data, so their single rows are broadcast and the many rows stay where they are;
the rows of all other keys shuffle, and no task gets more than that share of them per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be hot at once, and rows under which no key is.
HOT_KEYS, HOT_ROWS = 2_000, 50_000


def threshold(rows: int) -> int:
    """Rows from which a key is hot, so that at most HOT_KEYS keys are."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def hot_keys(many: DataFrame, on: str, rows: int) -> DataFrame | None:
    """The hot values of ``on`` (at most HOT_KEYS rows), or None where there are none. Counting combines before the shuffle."""
    if rows < HOT_ROWS:
        return None
    return hot_counted(many.groupBy(on).agg(F.count("*").alias("n")), on, rows)


def hot_counted(counts: DataFrame, on: str, rows: int) -> DataFrame | None:
    """``hot_keys`` from counts (on, n) at hand."""
    if rows < HOT_ROWS:
        return None
    found = counts.filter(F.col("n") >= threshold(rows)).select(on)
    keys = found.collect()  # at most HOT_KEYS
    return many_literals(found, keys) if keys else None


def many_literals(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, like.schema)


def join_one(many: DataFrame, one: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (one row per ``on``); ``how`` is inner or left."""
    if hot is None:
        return many.join(one, on, how)
    mark = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    marked = many.join(mark, on, "left")
    few = F.broadcast(one.join(F.broadcast(hot), on, "left_semi"))
    often = marked.filter("is_hot").drop("is_hot").join(few, on, how)
    return often.unionByName(marked.filter("is_hot is null").drop("is_hot").join(one, on, how))
