"""File sources and sinks: parquet folders, delimited text, row partitions and multi-table reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.functions.nulls import blank_to_null
from pubmeter.operators.ordering import row_index


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """One file, or every shard of a folder in a single scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def read_numbered_files(spark: SparkSession, folder: str, stem: str = "partition") -> DataFrame:
    """Files or folders ``<stem>_<i>.parquet`` of one folder in one scan, the number kept as column ``part``."""
    part = F.regexp_extract(F.col("_metadata.file_path"), rf"/{stem}_(\d+)\.parquet", 1).cast("int")
    return spark.read.parquet(f"{folder}/{stem}_*.parquet").select("*", part.alias("part"))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ";",
    header: bool = False,
    null_token: str = "NULL",
) -> DataFrame:
    """Delimited text with an explicit schema; the null token and blank cells become null, cells are trimmed."""
    raw = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("nullValue", null_token)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return raw.select(
        *[
            blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in schema.fields
        ]
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def chunked_parquet(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet with at most ``rows_per_file`` rows in any file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    (
        df.write.mode("overwrite")
        .option("sep", sep)
        .option("header", header)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Several named result tables under one folder; returns the path of each."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        write_parquet(df, paths[name])
    return paths


def write_row_partitions(df: DataFrame, path: str, order: str, size: int = 500_000) -> None:
    """Rows in ``order`` go to partition ``row // size + 1``; every partition but the last is full.

    ``order`` must be unique. The rows of one part are shuffled together once, so a part is one file.
    """
    parts = row_partitions(df, order, size)
    parts.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def row_partitions(df: DataFrame, order: str, size: int = 500_000) -> DataFrame:
    """``df`` with its 1-based partition number in ``part``."""
    indexed = row_index(df, order, "_row", wide=True)
    return indexed.withColumn("part", F.expr(f"cast(_row div {int(size)} + 1 as int)")).drop("_row")


def read_row_partitions(spark: SparkSession, path: str) -> DataFrame:
    """All parts of :func:`write_row_partitions`; a filter on ``part`` prunes folders."""
    return spark.read.parquet(path)


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """Name a result for later SQL; nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
