"""Merging the topics of separately modelled partitions into one set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.neighbours import pairs_within
from pubmeter.operators.ordering import first_rows, row_index
from pubmeter.operators.skew import skew_join
from pubmeter.session import cut_lineage

# Fixed value: topics at least this similar become one.
MIN_SIMILARITY = 0.7


def merge_topics(
    centroids: DataFrame, min_similarity: float = MIN_SIMILARITY, part: str = "part", topic: str = "topic"
) -> tuple[DataFrame, DataFrame]:
    """Mapping ``part, topic, merged`` and merged centroids ``merged, vec``.

    Parts are taken in ascending order. A topic joins the most similar topic found in earlier parts if the
    similarity suffices, and is a new topic otherwise; a topic keeps the vector it was found with. Only
    centroid tables take part: documents are remapped afterwards, by a join. The outlier topic stays itself.

    The fold is not run part by part. One table holds the similar pairs of topics of different parts. A topic with a new
    topic among its earlier partners joins, one whose earlier partners have all joined others is new: rounds over all parts at once settle
    every topic that can be told by now, so their number is that of the longest chain of topics that wait for each other.
    """
    real = centroids.where(F.col(topic) != -1).select(F.col(part).alias("part"), F.col(topic).cast("bigint").alias("topic"), "vec")
    placed = cut_lineage(row_index(real.withColumn("_order", F.struct("part", "topic")), "_order", "n").drop("_order"))
    ends = lambda c: placed.select(F.col("n").alias(c), F.col("part").alias(f"part_{c}"))
    close = pairs_within(placed.select("n", "vec"), 1 - min_similarity + 1e-9, "n")
    # the earlier part has the smaller number
    pairs = close.join(ends("a"), "a").join(ends("b"), "b").where((F.col("part_a") != F.col("part_b")) & (1 - F.col("distance") >= min_similarity))
    pairs = cut_lineage(pairs.select(F.col("b").alias("n"), F.col("a").alias("earlier"), "distance"))
    settled = cut_lineage(placed.select("n").join(pairs, "n", "left_anti").withColumn("new", F.lit(True)))
    waiting = cut_lineage(pairs.select("n", "earlier"))
    while not waiting.isEmpty():
        told = waiting.join(settled.select(F.col("n").alias("earlier"), "new"), "earlier", "left").groupBy("n")
        known = cut_lineage(told.agg(F.coalesce(F.bool_or("new"), F.lit(False)).alias("joins"), F.bool_and(F.col("new").isNotNull()).alias("all")))
        now = known.where("joins OR all").select("n", (~F.col("joins")).alias("new"))
        settled = cut_lineage(settled.unionByName(now))
        waiting = cut_lineage(waiting.join(now, "n", "left_anti"))
    found = placed.join(settled.where("new").select("n"), "n", "left_semi")
    # topics of the first part keep their numbers, new ones of later parts go on from there in order
    start = placed.agg(F.min("part").alias("p")).scalar()
    first = found.where(F.col("part") == start).select("n", F.col("topic").alias("merged"))
    offset = placed.where(F.col("part") == start).agg(F.max("topic").alias("m")).scalar()
    later = row_index(found.where(F.col("part") != start).select("n"), "n", "_place").select("n", (offset + 1 + F.col("_place")).alias("merged"))
    numbers = cut_lineage(first.unionByName(later))
    options = pairs.join(numbers.select(F.col("n").alias("earlier"), "merged"), "earlier")
    best = first_rows(options.select("n", "distance", "merged"), ["n"], [F.asc("distance"), F.asc("merged")]).select("n", F.col("merged").alias("_found"))
    mapped = placed.join(numbers, "n", "left").join(best, "n", "left")
    mapping = cut_lineage(mapped.select(F.col("part").alias(part), F.col("topic").alias(topic), F.coalesce("merged", "_found").alias("merged")))
    return mapping, cut_lineage(found.join(numbers, "n").select("merged", "vec"))


def remap_documents(doc_topic: DataFrame, mapping: DataFrame, part: str = "part", topic: str = "topic") -> DataFrame:
    """Documents with their merged topic number; outliers stay outliers."""
    numbered = doc_topic.withColumn(topic, F.col(topic).cast("bigint"))
    joined = skew_join(numbered, mapping, [part, topic], "left", profile=numbered)
    return joined.withColumn(topic, F.coalesce("merged", topic).cast("int")).drop("merged")
