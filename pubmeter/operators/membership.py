"""Membership of one table's key in another: kept rows, dropped rows or a flag column.

A missing key is a value like any other here: it is a member if the other table holds a missing key, and
no test ever answers null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.skew import skew_join


def members(
    df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return skew_join(df, _keys(other, key, other_key), key, "left_semi", profile, null_safe=True)


def non_members(
    df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return skew_join(df, _keys(other, key, other_key), key, "left_anti", profile, null_safe=True)


def with_flag(
    df: DataFrame, other: DataFrame, key: str, flag: str, other_key: str | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """``df`` with a boolean column telling whether its key occurs in ``other``."""
    held = _keys(other, key, other_key).withColumn(flag, F.lit(True))
    marked = skew_join(df, held, key, "left", profile, null_safe=True)
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False)))


def group_any(df: DataFrame, group: str, condition: Column, name: str, profile: DataFrame | None = None) -> DataFrame:
    """``df`` with a flag that is true on every row of a group in which some row meets the condition.

    The flag is aggregated per group and joined back: a window would hold the largest group in one task.
    """
    per_group = df.groupBy(group).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias(name))
    return skew_join(df, per_group, group, "left", profile)


def _keys(other: DataFrame, key: str, other_key: str | None) -> DataFrame:
    # combined in each map task first, so a key with many copies is one row in the shuffle
    return other.select(F.col(other_key or key).alias(key)).distinct()
