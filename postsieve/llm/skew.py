"""Joins whose hot keys are not dealt to one task.

A key is hot if it has more than one in ``HOT`` of all rows, so there are at most ``HOT`` hot keys:
what is broadcast has a proven bound at any size, and no task gets more rows of a key than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1024
#: Rows that a key may always have in one task.
UNIT = 64


def join_keyed(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the narrow rows of ``table``, one for each key; ``weight`` tells how many of the ``total`` rows the key has. Inner or left.

    Hot keys' rows are broadcast, so ``rows`` with them stay where they are; the others meet by a shuffle.
    """
    is_hot = F.col(weight) > max(UNIT, total / HOT)
    hot = F.broadcast(table.filter(is_hot).drop(weight))
    cold = table.filter(~is_hot).drop(weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, how))


def join_wide(rows: DataFrame, table: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """``rows`` with the rows of ``table``, however wide, of the same ``key``. ``rows`` of a hot key are dealt over salts by the column ``by``, and its rows in ``table`` copied to each: one copy for a task's worth of rows."""
    unit = max(UNIT, total / HOT)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > unit)
    hot = F.broadcast(counts.select(key, F.ceil(F.col("__n") / unit).cast("int").alias("__salts")))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    copied = table.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")
