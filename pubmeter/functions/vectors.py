"""Array vectors: products, norms and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def rescale(df: DataFrame, vec: str, factor: float = 10_000.0, by: str | None = None) -> DataFrame:
    """Every component over ``factor`` times the population deviation of the first one, over all rows or those of each ``by``."""
    first = F.stddev_pop(F.col(vec)[0]) * factor
    if by:
        spread = df.groupBy(F.col(by).alias("_by")).agg(first.alias("_scale"))
        scaled = df.join(spread, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    else:
        scaled = df.withColumn("_scale", df.agg(first.alias("s")).scalar())
    return scaled.withColumn(vec, F.transform(vec, lambda x: F.try_divide(x.cast("double"), F.col("_scale")))).drop("_scale")
