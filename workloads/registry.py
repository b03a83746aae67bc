"""Registration of queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Tables:
    """The supplied tables as attributes, each one parquet scan."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows.

    ``doubles`` names the columns that the SQL result is rounded in, as :func:`rounded` does for Spark.
    """

    def register(function: Query) -> Query:
        name = function.__name__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = function
        if sql is not None:
            replaced = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in doubles.split())
            _SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql
        return function

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, whole counts as bigint: the common form of both engines' results."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, DIGITS)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: rounded(function(Tables(spark, folder)))

    return {name: bind(function) for name, function in _QUERIES.items()}


@cache
def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
