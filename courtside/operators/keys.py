"""Joins and picks on keys that may be null and may be very uneven.

Joins are plain equi-joins: adaptive execution broadcasts a side only after measuring it and splits a skewed partition
of the other kind of join (``session.tune`` turns both on). Picks are ``row_number() = 1``, which Spark limits to one
row per key in every map task before it shuffles, so a hot key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left",
            null_safe: bool = True) -> DataFrame:
    """Join on equal columns (null equals null unless told otherwise); the key columns of ``left`` stay."""
    renamed = right
    for c in cols:
        renamed = renamed.withColumnRenamed(c, f"__r_{c}")
    condition = None
    for c in cols:
        one = left[c].eqNullSafe(renamed[f"__r_{c}"]) if null_safe else left[c] == renamed[f"__r_{c}"]
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in cols])


def lookup(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table that holds a key at most once; null finds nothing."""
    return join_on(left, right, cols, how, null_safe=False)


def pick_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1).drop("__rank")
