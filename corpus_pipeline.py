"""A corpus pipeline: toxic documents, boilerplate lines and near-duplicates go, the rest is mixed to weights and packed.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns the columns of ``documents``;
the last returns packed pieces. The table ``labels`` of ``sf_dir`` teaches the classifiers; labels of documents that are not
in ``docs`` teach nothing. Each stage's result is written as Parquet and read again by the next.

A missing text counts as empty and stays missing until it is packed; rows may repeat or lack an id; tables may be empty or
carry further columns: the operators' docstrings give the result of each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmeter.llm.lines import SHORT, drop_boilerplate
from pubmeter.llm.mixing import TARGETS, draw
from pubmeter.llm.mixing import fit as fit_mixture
from pubmeter.llm.packing import pack
from pubmeter.llm.registered import domains, table, vocabulary
from pubmeter.llm.simhash import drop_near_duplicates
from pubmeter.llm.toxicity import drop_toxic
from pubmeter.llm.toxicity import fit as fit_toxicity
from pubmeter.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; every document stays, with its new length."""
    cleaned = drop_boilerplate(docs, short=SHORT)
    size = F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints of three-word shingles lie within three bits the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at rates, at most one, that bring the domains to their target weights."""
    return draw(docs, fit_mixture(docs, domains(spark, sf_dir), TARGETS, most=1.0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return pack(docs, vocabulary("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("mixing", mixing), ("packing", packing)]
# Trained trees, fingerprints and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
