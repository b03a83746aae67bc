"""Global positions and ranks without a single-task window, and top rows per group.

A position needs the number of rows before each one. The rows are range-partitioned by their key, whatever its type, into
as many ranges as their number asks for; each range is numbered by itself and shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmeter.session import cut_lineage

# Rows that one task sorts and numbers.
ROWS_PER_RANGE = 1_000_000
# Wide rows that are worth a range of their own, as long as the session's shuffles have tasks for the ranges.
WIDE_ROWS_PER_RANGE = 2_000
# Up to this many rows per group Spark limits each map task before the shuffle; beyond it the same is done here.
MAP_SIDE_LIMIT = 1000


def running_total(df: DataFrame, order: str, amount: Column, name: str, by: str | None = None, wide: bool = False) -> DataFrame:
    """Sum of ``amount`` over all rows, of the same ``by`` if given, whose ``order`` is smaller; ``order`` is unique among them.

    ``df`` is read to count it, to sample its keys and to write it by ranges of them. A group of any size spans as many
    ranges as it needs. ``wide`` rows, such as texts, are spread over as many ranges as a shuffle has tasks.
    """
    rows = df.count()
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    if wide:
        ranges = max(ranges, min(-(-rows // WIDE_ROWS_PER_RANGE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    group = [by] if by else []
    ranged = cut_lineage(df.withColumn("_amount", amount).repartitionByRange(ranges, *group, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*([F.col(by).alias("_shift_by")] if by else []), F.col("_range").alias("_shift_range"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    placed = ranged.withColumn("_local", local)
    # one row per range and group within it, so a millionth of the rows where groups are large
    same = F.col("_range") == F.col("_shift_range")
    met = placed.join(shifts, same & F.col(by).eqNullSafe(F.col("_shift_by")) if by else same)
    total = (F.col("_shift") + F.col("_local")).alias(name)
    return met.select(*(F.col(c) for c in df.columns if c != name), total)


def row_index(df: DataFrame, order: str, name: str = "row_index", wide: bool = False) -> DataFrame:
    """Zero-based position of every row in ``order``, which must be unique."""
    return running_total(df, order, F.lit(1), name, wide=wide)


def average_rank(df: DataFrame, value: str, name: str = "rank", weight: Column | None = None, by: str | None = None) -> DataFrame:
    """One row per distinct value (of each ``by``): the value, its count ``n`` and its average rank among all rows.

    With ``weight`` a row stands for that many equal ones.
    """
    group = [by] if by else []
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(n.alias("n")))
    ranked = running_total(counts, value, F.col("n"), "_before", by)
    return ranked.select(*group, value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias(name))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: str | None = None, name: str = "quantiles") -> DataFrame:
    """One row (per ``by``): the number ``n`` of known values and the array of their exact quantiles.

    The quantile p lies at the place (n - 1) p of the ordered values, counted from 0, and between two values is interpolated.
    Equal values are one row, and the two order statistics of a quantile are picked from the running counts, so nothing is
    sorted in one task. A group without known values has no row.
    """
    group = [by] if by else []
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy(*([F.col(by).alias("_size_by")] if by else [])).agg(F.sum("_n").alias("n"))
    placed = running_total(counts, "_value", F.col("_n"), "_before", by)
    met = placed.join(sizes, F.col(by).eqNullSafe(F.col("_size_by")) if by else F.lit(True))
    wanted = F.transform(
        F.array(*(F.lit(float(p)) for p in probabilities)), lambda p, k: F.struct(k.alias("k"), F.floor((F.col("n") - 1) * p).alias("low"), F.ceil((F.col("n") - 1) * p).alias("high"), ((F.col("n") - 1) * p).alias("at"))
    )
    holds = lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_n"))
    picked = met.select(*group, "n", "_value", "_before", "_n", F.explode(F.filter(wanted, lambda w: holds(w["low"]) | holds(w["high"]))).alias("w"))
    low, high = (F.max(F.when(holds(F.col("w")[side]), F.col("_value"))) for side in ("low", "high"))
    share = F.max(F.col("w.at") - F.col("w.low"))
    each = picked.groupBy(*group, "n", F.col("w.k").alias("_k")).agg((low + share * (high - low)).alias("_q"))
    return each.groupBy(*group, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias(name))


def sequence_id(df: DataFrame, order: str, name: str = "topic") -> DataFrame:
    """Zero-based id by position."""
    return row_index(df, order, name)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group in a total ``order``.

    Spark keeps at most ``k`` rows per group and map task before it shuffles, so a huge group costs no
    more than a small one. For a ``k`` above its limit the same is done here over salted groups, with the same rows.
    """
    if k > MAP_SIDE_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= k)
        df = df.drop("_salt", "_rn")
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key: the smallest by ``order``, by default by all other columns, nulls last."""
    rest = order or [c for c in df.columns if c not in keys]
    return first_rows(df, keys, [F.col(c).asc_nulls_last() for c in rest])


def top_with_ties(df: DataFrame, measure: str, n: int, ascending: bool = False) -> DataFrame:
    """Rows whose rank by ``measure`` is at most ``n``, ties kept, nulls ranked last.

    The n-th value is found by a top-n, and all rows are compared with it: ties may be any number of
    rows and never meet in one task.
    """
    # the last bits of a sum depend on its order, so equal measures are those equal to twelve digits
    c = F.round(measure, 12) if dict(df.dtypes)[measure] == "double" else F.col(measure)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    edge = F.max(c) if ascending else F.min(c)
    nth = df.orderBy(order).limit(n).agg(F.when(F.max(c.isNull()), None).otherwise(edge).alias("v")).scalar()
    within = c <= nth if ascending else c >= nth
    return df.where(nth.isNull() | F.coalesce(within, F.lit(False)))


def extremes(df: DataFrame, measure: str, n: int = 25) -> DataFrame:
    """The top and the bottom ``n`` with ties; a row may be in both."""
    return top_with_ties(df, measure, n).unionByName(top_with_ties(df, measure, n, ascending=True))


def level_order(c: Column, levels: Sequence[str]) -> Column:
    """1-based place of a category in an explicit list; null outside it."""
    ordered = None
    for i, level in enumerate(levels, 1):
        ordered = F.when(c == level, i) if ordered is None else ordered.when(c == level, i)
    return ordered
