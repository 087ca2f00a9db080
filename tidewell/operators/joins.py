"""Joins whose frequent keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_size(left: DataFrame, right: DataFrame, on: str, rows: str, total: int) -> DataFrame:
    """The inner join on a string key that ``right`` has once for each value, with the number of its rows
    in ``left`` in the column ``rows``, which is dropped.

    Keys with more than a thousandth of ``total`` rows are found by broadcast, and their rows then spread
    over the tasks of the join of all others; ``left`` is read once. Where every row of ``left`` stands
    for one of ``total`` things there are fewer than a thousand such keys; where it stands for a part of
    one, a thousand times the mean number of parts bounds them.
    """
    often = F.col(rows) > max(1000, total // 1000)
    values = [c for c in right.columns if c not in (on, rows)]
    hot = right.where(often).select(on, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = right.where(~often).select(F.col(on).alias("_key"), F.lit(True).alias("_rest"), *[F.col(c).alias(f"_rest_{c}") for c in values])
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("string"))
    keyed = left.join(F.broadcast(hot), on, "left").withColumn("_key", F.when(F.col("_hot"), spread).otherwise(F.col(on)))
    found = keyed.join(rest, "_key", "left").where(F.col("_hot").isNotNull() | F.col("_rest").isNotNull())
    return found.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values])
