"""Counts of distinct things, shares, fractional counts and weighted statistics.

Distinct counts first reduce to one row per (group, id) with its flags, then add flags: one shuffle on a key
that no group can dominate, whatever the number of conditions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmeter.session import cut_lineage


def distinct_counts(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    conditions: Mapping[str, Column] | None = None,
    total: str | None = "n",
    missing_counts: bool = False,
) -> DataFrame:
    """Number of distinct ``key`` per group, in total and under each condition.

    With ``missing_counts`` a missing value is one more distinct value: a missing key counts, and a
    condition that is unknown on some row of the group adds one to its count.
    """
    conditions = dict(conditions or {})
    flags = {f"_f{i}": c for i, c in enumerate(conditions.values())}
    per_key = df.groupBy(*groups, key).agg(
        F.lit(1).alias("_row"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f) for f, c in flags.items()],
        *[F.bool_or(c.isNull()).alias(f"{f}_unknown") for f, c in flags.items()],
    )
    present = F.col(key).isNotNull()
    counted = F.lit(True) if missing_counts else present
    out = []
    for name, flag in zip(conditions, flags):
        n = F.sum(F.when(F.col(flag) & present, 1).otherwise(0))
        if missing_counts:
            no_value = F.col(f"{flag}_unknown") | (F.col(flag) & ~present)
            n = n + F.coalesce(F.max(no_value.cast("int")), F.lit(0))
        out.append(n.cast("bigint").alias(name))
    if total:
        out.append(F.sum(F.when(counted, 1).otherwise(0)).cast("bigint").alias(total))
    grouped = per_key.groupBy(*groups) if groups else per_key.groupBy()
    return grouped.agg(*out)


def frequency(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Row count per value; missing values are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def share_within(df: DataFrame, measure: str, within: Sequence[str], name: str = "p") -> DataFrame:
    """``measure`` over its sum in the group. ``df`` is an aggregate with a few rows per group."""
    return df.withColumn(name, F.try_divide(F.col(measure), F.sum(measure).over(Window.partitionBy(*within))))


def share_of_total(df: DataFrame, measure: str, name: str = "p") -> DataFrame:
    """``measure`` over its grand total. The aggregate is materialised, so that its input is read once."""
    df = cut_lineage(df)
    total = df.agg(F.sum(measure).alias("t")).scalar()
    return df.withColumn(name, F.try_divide(F.col(measure), total))


def share_where(measure: Column, condition: Column) -> Column:
    """Aggregate: the part of a sum that meets a condition."""
    return F.try_divide(F.sum(F.when(condition, measure)), F.sum(measure))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean weighted over the rows that have a value."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def fractional_shares(
    memberships: DataFrame, unit: str, member: str, category: str, categories: Sequence[str], copies: bool = True
) -> DataFrame:
    """Share of each unit's distinct members by category, one column per category, missing ones zero.

    Rows without a category do not enter the denominator, and a unit without any such row is left out. Without ``copies`` the
    three columns of no two rows are equal, and no table of them is held to look for some.
    """
    cells = memberships.where(F.col(category).isin(*categories)).select(unit, member, category)
    cells = cells.distinct() if copies else cells
    counted = cells.groupBy(unit).agg(
        *[F.sum(F.when(F.col(category) == c, 1).otherwise(0)).alias(c) for c in categories],
        F.count(F.lit(1)).alias("_all"),
    )
    return counted.select(unit, *[(F.col(c) / F.col("_all")).alias(c) for c in categories])


def unpivot_all(df: DataFrame, ids: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form of every column but ``ids``."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in df.columns if c not in ids], name, value)


def representation_ratio(
    base: DataFrame, flag: str, value: str, domain: str, key: str, groups: Sequence[str]
) -> DataFrame:
    """Observed over expected share of a flag value per domain and group, minus one.

    Observed: the group's part of the flag value in the domain; expected: all works' part. Both come from one
    table of sums and works per (flag, domain).
    """
    per_work = base.groupBy(flag, domain, key).agg(*[F.sum(g).alias(g) for g in groups])
    cells = per_work.groupBy(flag, domain).agg(*[F.sum(g).alias(g) for g in groups], F.count(F.lit(1)).alias("p_norm"))
    whole = Window.partitionBy(domain)
    shares = cells.select(flag, domain, *[F.try_divide(F.col(c), F.sum(c).over(whole)).alias(c) for c in (*groups, "p_norm")])
    chosen = shares.where(F.col(flag) == value)
    long = chosen.unpivot([flag, domain, "p_norm"], list(groups), "gender", "p")
    return long.select(flag, domain, "gender", "p", "p_norm", (F.try_divide("p", "p_norm") - 1).alias("x"))


def dominant_category(counts: DataFrame, group: str, category: str, n: str, threshold: float, otherwise: str) -> DataFrame:
    """The category with the largest share in each group, or ``otherwise`` where that share is too small."""
    best = counts.groupBy(group).agg(
        F.max_by(F.col(category), F.struct(F.col(n), F.col(category))).alias("_top"),
        (F.max(n) / F.sum(n)).alias("_share"),
    )
    chosen = F.when(F.col("_share") < threshold, F.lit(otherwise)).otherwise(F.col("_top"))
    return best.select(group, chosen.alias(category))
