"""Scalar functions over whole text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions import text as X
from pubmeter.functions.nulls import with_missing
from pubmeter.operators.statistics import quadrant
from pubmeter.plans.matching import search_dois, search_titles
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import prelude

SQUISH = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\p{P}\p{S}]', ' ', 'g')) AS digest FROM documents")
def punctuation_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.punctuation_to_space(F.col("text"))).alias("digest"))


@query(
    """SELECT doc_id, md5(replace(replace(replace(text, 'The', ''), 'der', ''), 'ou', '')) AS digest,
    length(replace(replace(replace(text, 'The', ''), 'der', ''), 'ou', '')) AS c FROM documents"""
)
def words_removed(t: Tables) -> DataFrame:
    """Listed words go, in order, also inside longer words."""
    cut = X.drop_words(F.col("text"), ["The", "der", "ou"])
    return t.documents.select("doc_id", F.md5(cut).alias("digest"), F.char_length(cut).alias("c"))


@query(f"SELECT doc_id, md5({SQUISH.format('text')}) AS digest, length({SQUISH.format('text')}) AS c FROM documents")
def squished_text(t: Tables) -> DataFrame:
    s = X.squish(F.col("text"))
    return t.documents.select("doc_id", F.md5(s).alias("digest"), F.char_length(s).alias("c"))


@query(
    f"SELECT DISTINCT {SQUISH.format(f'''regexp_replace(regexp_replace({SQUISH.format('raw')}, '^doi:', ''), '^DOI:', '')''')} AS doi "
    "FROM (SELECT CASE l_orderkey % 3 WHEN 0 THEN ' doi:DOI:10.55/' || l_orderkey WHEN 1 THEN 'DOI: 10.55/' || l_orderkey ELSE '10.55/' || l_orderkey || '  ' END AS raw FROM lineitem)"
)
def normalised_identifiers(t: Tables) -> DataFrame:
    key, kind = F.col("l_orderkey"), F.col("l_orderkey") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit(" doi:DOI:10.55/"), key))
        .when(kind == 1, F.concat(F.lit("DOI: 10.55/"), key))
        .otherwise(F.concat(F.lit("10.55/"), key, F.lit("  ")))
    )
    return t.lineitem.select(X.normalise_doi(raw).alias("doi")).distinct()


@query("SELECT page_id, md5(replace(html, '\"', '')) AS digest FROM pages")
def double_quotes_removed(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_double_quotes(F.col("html"))).alias("digest"))


@query(
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(regexp_replace(p_name, '^[^ ]* ?', ''), '') AS rest FROM part"""
)
def name_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.first_word(F.col("p_name")).alias("first"), X.words_after_first(F.col("p_name")).alias("rest"))


@query("SELECT p_partkey, regexp_replace(p_partkey || ' - ' || p_name || ' - ' || p_type, '^.* - ', '') AS label FROM part")
def label_suffix(t: Tables) -> DataFrame:
    full = F.concat_ws(" - ", "p_partkey", "p_name", "p_type")
    return t.part.select("p_partkey", X.after_last_dash(full).alias("label"))


@query(
    """SELECT o_orderkey, CAST(round_even(o_custkey / 2, 0) AS BIGINT) AS half,
    CASE WHEN pct = floor(pct) THEN CAST(CAST(pct AS BIGINT) AS VARCHAR) ELSE CAST(pct AS VARCHAR) END || '%' AS label FROM
    (SELECT o_orderkey, o_custkey, round_even(o_custkey % 64 / 64 * 100, 1) AS pct FROM orders)"""
)
def rounded_labels(t: Tables) -> DataFrame:
    """Halves go to the even neighbour; a share prints as a percentage."""
    share = F.col("o_custkey") % 64 / 64
    half = X.round_half_even(F.col("o_custkey") / 2).cast("bigint")
    return t.orders.select("o_orderkey", half.alias("half"), X.percent_text(share).alias("label"))


@query(
    """SELECT l_suppkey, sum(l_quantity) / nullif(sum(l_tax), 0) - 1 AS x FROM lineitem GROUP BY l_suppkey""",
    doubles="x",
)
def safe_ratios(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg((F.try_divide(F.sum("l_quantity"), F.sum("l_tax")) - 1).alias("x"))


@query("SELECT p_partkey, trim('  ' || p_name || ' - ' || coalesce(nullif(p_brand, 'Brand#2'), 'NA') || ' ') AS label FROM part")
def pasted_labels(t: Tables) -> DataFrame:
    """Text joined with a missing part shown as NA, then trimmed."""
    brand = with_missing(F.nullif("p_brand", F.lit("Brand#2")))
    return t.part.select("p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" - "), brand, F.lit(" "))).alias("label"))


@query(
    """SELECT p_partkey, CASE WHEN p_size >= ms AND p_retailprice >= mp THEN 'hh' WHEN p_size >= ms THEN 'hl' WHEN p_retailprice >= mp THEN 'lh' ELSE 'll' END AS class
    FROM part, (SELECT avg(p_size) AS ms, avg(p_retailprice) AS mp FROM part)"""
)
def quadrant_labels(t: Tables) -> DataFrame:
    mid = {c: t.part.agg(F.avg(c).alias("m")).scalar() for c in ("p_size", "p_retailprice")}
    label = quadrant(F.col("p_size"), F.col("p_retailprice"), mid["p_size"], mid["p_retailprice"], ["hh", "hl", "lh", "ll"], "?")
    return t.part.select("p_partkey", label.alias("class"))


@query(
    prelude("pubs")
    + r"""SELECT DISTINCT trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) AS title, year FROM pubs
    WHERE length(trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g'))) > 10"""
)
def search_title_list(t: Tables) -> DataFrame:
    return search_titles(roles.pubs(t))


@query(
    prelude("pubs") + f"SELECT DISTINCT {SQUISH.format(f'''regexp_replace(regexp_replace({SQUISH.format('doi')}, '^doi:', ''), '^DOI:', '')''')} AS doi FROM pubs WHERE doi IS NOT NULL"
)
def search_doi_list(t: Tables) -> DataFrame:
    return search_dois(roles.pubs(t))
