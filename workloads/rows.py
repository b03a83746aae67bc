"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.nulls import if_else, in_list, is_filled, not_in, null_if_shorter, zero_if_null
from pubmeter.functions.text import longer_than, year_from
from pubmeter.operators.counting import distinct_counts, frequency, share_of_total
from pubmeter.operators.sampling import proportional_quota
from pubmeter.plans.reports import indexation
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import prelude


@query("SELECT s_suppkey AS author_id, s_name AS author_name, s_acctbal * 2 AS twice, 'Brazil' AS country FROM supplier", doubles="twice")
def column_projection(t: Tables) -> DataFrame:
    """Select, rename, computed and literal columns, dropped columns: only the used ones are scanned."""
    renamed = t.supplier.drop("s_nationkey").withColumnsRenamed({"s_suppkey": "author_id", "s_name": "author_name"})
    return renamed.withColumns({"twice": F.col("s_acctbal") * 2, "country": F.lit("Brazil")}).drop("s_acctbal")


@query(prelude("pubs") + "SELECT year, count(*) AS n FROM pubs WHERE try_cast(year AS BIGINT) >= 1997 GROUP BY year")
def safe_year_filter(t: Tables) -> DataFrame:
    return frequency(roles.pubs(t).where(year_from(F.col("year"), roles.FIRST_YEAR)), "year")


@query(prelude("pubs") + "SELECT doi, count(*) AS n FROM pubs WHERE doi IS NOT NULL AND doi <> '' GROUP BY doi")
def filled_strings(t: Tables) -> DataFrame:
    return frequency(roles.pubs(t).where(is_filled(F.col("doi"))), "doi")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_quantity >= 45 AND l_returnflag = 'R' AND NOT (l_discount > 0.05) AND l_linestatus IN ('O', 'X')""",
    doubles="l_quantity",
)
def comparison_filter(t: Tables) -> DataFrame:
    """Equality, comparison, negation and a code set, all pushed to the scan."""
    kept = t.lineitem.where((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R") & ~(F.col("l_discount") > 0.05))
    return kept.where(F.col("l_linestatus").isin("O", "X")).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(
    prelude("language")
    + "SELECT coalesce(language, 'none') AS language, count(*) AS n FROM language WHERE language IS NULL OR language NOT IN ('en', 'pt') GROUP BY 1"
)
def outside_list(t: Tables) -> DataFrame:
    """A missing value is outside every list."""
    kept = roles.language(t).where(not_in(F.col("language"), ["en", "pt"]))
    return frequency(kept.withColumn("language", F.coalesce("language", F.lit("none"))), "language")


@query(prelude("language") + "SELECT language, count(*) AS n FROM language WHERE language IN ('en', 'pt') GROUP BY 1")
def inside_list(t: Tables) -> DataFrame:
    return frequency(roles.language(t).where(in_list(F.col("language"), ["en", "pt"])), "language")


@query("SELECT doc_id, length(text) AS c FROM documents WHERE length(text) > 15")
def length_filter(t: Tables) -> DataFrame:
    return t.documents.where(longer_than(F.col("text"), 15)).select("doc_id", F.char_length("text").cast("bigint").alias("c"))


@query(
    prelude("pubs")
    + """SELECT count(doi_ok) AS dois, count(issn_ok) AS issns, count(*) AS n FROM (
      SELECT CASE WHEN length(doi) >= 7 THEN doi END AS doi_ok, CASE WHEN length(issn) >= 3 THEN issn END AS issn_ok FROM pubs)"""
)
def conditional_nulls(t: Tables) -> DataFrame:
    fixed = roles.pubs(t).select(
        null_if_shorter(F.nullif("doi", F.lit("")), 7).alias("doi"), null_if_shorter(F.col("issn"), 3).alias("issn")
    )
    return fixed.agg(F.count("doi").alias("dois"), F.count("issn").alias("issns"), F.count(F.lit(1)).alias("n"))


@query(
    prelude("pubs")
    + "SELECT journal IS NOT NULL AS has_journal, doi IS NULL AS no_doi, count(*) AS n FROM pubs GROUP BY ALL"
)
def presence_flags(t: Tables) -> DataFrame:
    flags = roles.pubs(t).select(F.col("journal").isNotNull().alias("has_journal"), F.col("doi").isNull().alias("no_doi"))
    return flags.groupBy("has_journal", "no_doi").agg(F.count(F.lit(1)).alias("n"))


@query(
    prelude("language")
    + """SELECT coalesce(label, 'unknown') AS label, count(*) AS n FROM (
      SELECT CASE WHEN language = 'en' THEN 'English' WHEN language IS NOT NULL THEN 'Other' END AS label FROM language) GROUP BY 1"""
)
def binary_choice(t: Tables) -> DataFrame:
    """A missing condition gives a missing label."""
    label = if_else(F.col("language") == "en", "English", "Other")
    return frequency(roles.language(t).select(F.coalesce(label, F.lit("unknown")).alias("label")), "label")


@query(
    """SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'Only A' WHEN toxic = 1 AND quality = 0 THEN 'Only B'
      WHEN toxic = 1 AND quality = 1 THEN 'A & B' ELSE 'Not indexed' END AS indexation, count(*) AS n, count(*) / (SELECT count(*) FROM labels) AS p
    FROM labels GROUP BY 1""",
    doubles="p",
)
def multiway_choice(t: Tables) -> DataFrame:
    flag = {n: F.when(F.col(c) == 1, "Indexed").otherwise("Not indexed") for n, c in (("in_a", "quality"), ("in_b", "toxic"))}
    classed = t.labels.withColumns(flag).withColumn("indexation", indexation())
    return share_of_total(distinct_counts(classed, ["indexation"], "doc_id"), "n")


@query(
    """SELECT c_custkey AS topic, CASE c_custkey WHEN 3 THEN '3 - Three' WHEN 7 THEN '7 - Seven' WHEN 11 THEN '11 - Eleven'
      ELSE c_custkey || ' - ' || c_mktsegment END AS label FROM customer"""
)
def label_overrides(t: Tables) -> DataFrame:
    """A small table of corrections, joined on; its size is the number of literals."""
    fixed = [(3, "3 - Three"), (7, "7 - Seven"), (11, "11 - Eleven")]
    overrides = t.spark.createDataFrame(fixed, "topic bigint, better string")
    named = t.customer.select(F.col("c_custkey").alias("topic"), F.concat("c_custkey", F.lit(" - "), "c_mktsegment").alias("label"))
    joined = named.join(F.broadcast(overrides), "topic", "left")
    return joined.select("topic", F.coalesce("better", "label").alias("label"))


@query(
    "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def zero_fill(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.withColumn("quality", zero_if_null(F.col("quality")))


@query(
    """SELECT event_type, n, CAST(round_even(n / sum(n) OVER () * 100, 0) AS BIGINT) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS quota
    FROM (SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type)"""
)
def quota_update(t: Tables) -> DataFrame:
    """A share of one hundred per stratum, with one stratum corrected by hand."""
    return proportional_quota(t.events, "event_type", "event_id", 100, {"click": 1})
