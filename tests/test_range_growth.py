"""Wide rows are numbered by more than one task."""

from pyspark.sql import functions as F

from pubmeter.sources.files import row_partitions


def test_wide_rows_are_numbered_by_many_tasks(spark):
    placed = row_partitions(spark.range(20_000).withColumn("title", F.lit("text")), "id", 2_500)
    assert len(placed.inputFiles()) > 1
    assert placed.where(F.col("part") != F.expr("cast(id div 2500 + 1 as int)")).isEmpty()
