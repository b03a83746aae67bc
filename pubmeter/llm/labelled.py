"""Labelled rows for the classifiers, and calibration of their scores."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4))


def training_ids(labels: DataFrame, id: str, label: str, rows: int) -> DataFrame:
    """``id, label, fold``: at most ``rows`` labelled ids, the first by hash, one row per id with its largest label.

    ``fold`` is 0 to 9, independent of the choice. Rows without id or label are left out.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    one = known.groupBy("id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(rows).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(10)))


def isotonic(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Calibration of ``score`` against ``label``: points of a rising line, at most two per row of the bounded sample."""
    model = IsotonicRegression(featuresCol="features", labelCol="label").fit(scores.select("label", array_to_vector(F.array("score")).alias("features")))
    return np.array(model.boundaries.toArray()), np.array(model.predictions.toArray())


def training_texts(docs: DataFrame, text: str, label: str, rows: int) -> DataFrame:
    """``text, label``: at most ``rows`` different labelled texts of each label, the first by a hash of text and label.

    The hashes alone are ranked, cut to ``rows`` of a label in the map tasks; the texts up to the last one taken are then filtered
    where they lie.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    place = F.xxhash64("text", "label").alias("place")
    ranked = known.select("label", place).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("place")))
    last = ranked.where(F.col("rank") <= rows).groupBy("label").agg(F.max("place").alias("last"))
    # one number per label, for a model that holds thousands for each
    return known.join(F.broadcast(last), "label").where(F.xxhash64("text", "label") <= F.col("last")).dropDuplicates(["text", "label"]).select("text", "label")
