"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one sub-key, as a part of a task's even share of all rows.
SHARE = 0.25
# At most this many keys are hot: their list is looked through for every row.
HOT_KEYS = 200
# Sub-keys of rows without a key, which no sketch counts.
SALTS = 64
# Keys that a sketch follows: enough to tell one percent, and a few kilobytes per map task.
TRACKED = 1_000
# Sketches of very many map tasks are combined by this many tasks before the last one.
COMBINERS = 64


def hot_hashes(df: DataFrame, keys: Sequence[str], share: float) -> Column:
    """Array of the hashes of the keys of ``df`` that hold more than ``share`` of its rows."""
    return hot_salts(df, keys, max(1, int(SHARE / share)))["hashes"]


def hot_salts(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> Column:
    """``hashes, salts``: two arrays, of the hot keys of ``df``, from sketches made in the map tasks.

    A key is hot if it has more rows than a part, ``SHARE``, of a task's even share of all, ``tasks`` being the session's
    shuffle partitions by default, and gets as many salts as it has such parts. At most ``HOT_KEYS`` keys are listed: keys
    with less than one in ``HOT_KEYS`` of all rows are not hot. Only the balance of a join depends on it, never its result.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(SHARE / tasks, 1 / HOT_KEYS)
    combiner = F.pmod(F.spark_partition_id(), F.lit(COMBINERS)).alias("_c")
    hashes = df.where(_all_present(keys)).select(F.xxhash64(*keys).alias("_h"), combiner)
    sketches = hashes.groupBy("_c").agg(F.expr(f"approx_top_k(_h, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    # at most COMBINERS arrays of HOT_KEYS entries, added up within one row
    frequent = F.filter("top", lambda t: t["count"] > F.col("n") * least / 4)
    listed = sketches.select(frequent.alias("top"), "n").agg(F.flatten(F.collect_list("top")).alias("top"), F.sum("n").alias("n"))
    own = lambda item: F.filter("top", lambda t: t["item"] == item)
    rows = lambda item: F.aggregate(own(item), F.lit(0).cast("bigint"), lambda total, t: total + t["count"])
    items = F.array_distinct(F.transform("top", lambda t: t["item"]))
    salts = lambda item: F.ceil(rows(item) * tasks / (F.col("n") * SHARE)).cast("int")
    hot = listed.select(F.filter(items, lambda item: rows(item) > F.col("n") * least).alias("hashes"), "top", "n")
    return hot.select(F.struct("hashes", F.transform("hashes", salts).alias("salts")).alias("hot")).scalar()


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    profile: DataFrame | None = None,
    null_safe: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join whose left side may have hot or missing keys.

    Left rows of a hot key are spread over sub-keys, as many as the key has times a task's share of rows, and the few right
    rows of that key are repeated once per sub-key; left rows without a key are spread too. All other keys join as usual.
    The hot keys are those of ``profile``: a table that is cheap to read and has the key distribution of
    ``left``, typically the scan that ``left`` was made from. Without it only missing keys are spread and hot
    ones are left to adaptive execution, which splits their partitions while the query runs.

    With ``null_safe`` a missing key equals a missing key. Left rows should differ from each other: equal rows
    share a sub-key, so remove copies first.
    """
    keys = [on] if isinstance(on, str) else list(on)
    present = _all_present(keys)
    if profile is None and not null_safe and how in ("inner", "left_semi"):
        return left.join(right, keys, how)
    salts = F.when(~present, SALTS).otherwise(1)
    if profile is not None:
        hot = hot_salts(profile, keys, tasks)
        place = F.array_position(hot["hashes"], F.xxhash64(*keys)).cast("int")
        salts = F.when(~present, SALTS).otherwise(F.coalesce(F.get(hot["salts"], place - 1), F.lit(1)))
    salted = left.withColumn("_salts", salts).withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*left.columns), F.col("_salts"))).otherwise(0).cast("int")).drop("_salts")
    held = right if null_safe else right.where(present)
    repeated = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    if not null_safe:
        return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
    renamed = repeated.withColumnsRenamed({k: f"_right_{k}" for k in [*keys, "_salt"]})
    same = F.col("_salt") == F.col("_right__salt")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return salted.join(renamed, same, how).drop("_salt", "_right__salt", *[f"_right_{k}" for k in keys])


def _all_present(keys: Sequence[str]) -> Column:
    present = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        present = present & F.col(key).isNotNull()
    return present
