"""Reproducible samples: the draw orders rows by an MD5 of seed and row, so it does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.counting import distinct_counts
from pubmeter.operators.ordering import first_rows
from pubmeter.session import cut_lineage

# Fixed value: the seed of every sample of the study.
SEED = 1234


def draw_order(columns: Sequence[str], seed: int = SEED) -> Column:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cells))


def one_per_key(df: DataFrame, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """One random row per key."""
    return sample_per_stratum(df, keys, 1, seed)


def sample_per_stratum(df: DataFrame, strata: Sequence[str], k: int, seed: int = SEED) -> DataFrame:
    """``k`` random rows per stratum, or all of a smaller one."""
    return first_rows(df, strata, [draw_order(df.columns, seed)], k)


def proportional_quota(
    df: DataFrame, stratum: str, key: str, size: int = 100, manual: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows to draw per stratum: its share of ``size``, rounded half to even.

    By default the strata with the largest remainders take up what rounding left over or short; ``manual``
    names the corrections instead. A missing stratum gets no quota. One row per stratum: a small table.
    """
    counts = cut_lineage(distinct_counts(df.where(F.col(stratum).isNotNull()), [stratum], key))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    exact = counts.withColumn("_exact", F.col("n") / total * size).withColumn("quota", F.bround("_exact").cast("bigint"))
    if manual is not None:
        add = F.lit(0)
        for name, extra in manual.items():
            add = add + F.when(F.col(stratum) == name, extra).otherwise(0)
        return exact.select(stratum, "n", (F.col("quota") + add).alias("quota"))
    left = (F.lit(size) - exact.agg(F.sum("quota").alias("q")).scalar()).cast("bigint")
    # Positive: the strata rounded down the most get one more; negative: those rounded up the most one less.
    urgency = (F.col("_exact") - F.col("quota")) * F.signum(left.cast("double"))
    # |left| never exceeds ``size``: rounding up at most doubles a share, rounding down loses no more than all of it.
    order = [F.desc("_urgency"), F.asc(stratum)]
    urgent = first_rows(exact.withColumn("_urgency", urgency), [], order, size, "_rn")
    changed = urgent.where(F.col("_rn") <= F.abs(left)).select(stratum, F.signum(left.cast("double")).alias("_step"))
    quota = F.col("quota") + F.coalesce(F.col("_step").cast("bigint"), F.lit(0))
    return exact.join(changed, stratum, "left").select(stratum, "n", quota.alias("quota"))


def proportional_sample(
    df: DataFrame,
    stratum: str,
    key: str,
    size: int = 100,
    manual: Mapping[str, int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Random rows per stratum up to its quota. No quota exceeds ``size`` plus its correction, which limits each map task."""
    quota = proportional_quota(df, stratum, key, size, manual)
    most = size + sum(max(v, 0) for v in (manual or {}).values())
    drawn = first_rows(df.where(F.col(stratum).isNotNull()), [stratum], [draw_order(df.columns, seed)], most, "_rn")
    return drawn.join(quota.select(stratum, "quota"), stratum).where(F.col("_rn") <= F.col("quota")).select(*df.columns)
