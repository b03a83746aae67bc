"""Helpers shared by the operators: texts, batches for Python workers, worker state and connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.session import cut_lineage

# Rows of a batch that goes to a Python worker: whole texts can be long.
BATCH_ROWS = 256


def texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``text`` alone, a missing text as the empty one."""
    return docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias(text))


def in_small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers a few hundred at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that a Python worker process makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_pubmeter_llm_state", types.ModuleType("_pubmeter_llm_state")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def keyed(docs: DataFrame, id: str, *columns: Column) -> DataFrame:
    """``key`` and ``columns``: a long that tells rows apart, the id itself where it does.

    Where ids repeat, are missing or are no integers, the rows are numbered and written out, so the numbers stay.
    """
    whole = isinstance(docs.schema[id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole and docs.groupBy(F.col(id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return docs.select(F.col(id).cast("long").alias("key"), *columns)
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("key"), *columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for each end of an edge; the component is the smallest id that can be reached.

    In each round every end hears the smallest label of its neighbours, tells it to the label it had, and takes the
    label of its label, so the number of rounds follows the logarithm of the longest path. Minima are combined in the
    map tasks, so a component of any size is no hot group. Labels are written out between rounds.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut_lineage(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("n")).select(F.col("u").alias("id"), F.least("u", "n").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("u"), F.col("component").alias("near")), "u").groupBy(F.col("v").alias("id")).agg(F.min("near").alias("near"))
        told = labels.join(heard, "id")
        low = F.least("component", "near")
        claims = told.select("id", low.alias("low"), F.col("component").alias("old")).unionByName(
            told.select(F.col("component").alias("id"), low.alias("low"), F.lit(None).cast(labels.schema["component"].dataType).alias("old"))
        )
        hopped = cut_lineage(claims.groupBy("id").agg(F.min("low").alias("component"), F.max("old").alias("old")))
        roots = hopped.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = cut_lineage(hopped.join(roots, "component", "left").select("id", F.least("component", "root").alias("component"), "old"))
        if labels.where("component <> old").isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("old")
