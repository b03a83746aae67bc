"""Reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.sampling import one_per_key, proportional_quota, proportional_sample, sample_per_stratum
from pubmeter.plans.matching import flag_matched
from pubmeter.plans.validation import known_author_sample, result_shares, unknown_author_sample, unmatched_article_sample
from pubmeter.plans.coverage import works_with_known_author
from pubmeter.session import cut_lineage
from workloads import roles
from workloads.indexes import NATIONAL, NATIONAL_ROLES, missing, national_index_articles
from workloads.registry import Tables, query
from workloads.roles import MATCH_ROLES, prelude

ORDERS = "o_orderkey, o_custkey, o_orderpriority"
DRAW = "md5(concat_ws('|', '1234', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority))"


def orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")


@query(f"SELECT {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {DRAW}) AS rn FROM orders) WHERE rn = 1")
def one_random_row_per_key(t: Tables) -> DataFrame:
    return one_per_key(orders(t), ["o_custkey"])


@query(f"SELECT {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {DRAW}) AS rn FROM orders) WHERE rn <= 25")
def stratified_sample(t: Tables) -> DataFrame:
    return sample_per_stratum(orders(t), ["o_orderpriority"], 25)


QUOTA = """
counts AS (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1),
exact AS (SELECT s, n, n / sum(n) OVER () * 97 AS e FROM counts),
r AS (SELECT s, n, e, round_even(e, 0) AS q FROM exact),
k AS (SELECT CAST(97 - sum(q) AS BIGINT) AS missing FROM r),
quota AS (SELECT s, n, CAST(q AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY (e - q) * sign(missing) DESC, s) <= abs(missing)
  THEN CAST(sign(missing) AS BIGINT) ELSE 0 END AS quota FROM r, k)"""


@query(f"WITH {QUOTA} SELECT s AS o_orderpriority, n, quota FROM quota")
def proportional_quotas(t: Tables) -> DataFrame:
    """Rounded shares of 97 rows, corrected by largest remainder."""
    return proportional_quota(t.orders, "o_orderpriority", "o_orderkey", 97)


@query(
    f"""WITH {QUOTA} SELECT {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {DRAW}) AS rn FROM orders)
    JOIN quota ON s = o_orderpriority WHERE rn <= quota"""
)
def proportional_stratified_sample(t: Tables) -> DataFrame:
    return proportional_sample(orders(t), "o_orderpriority", "o_orderkey", 97)


LINE_DRAW = "md5(concat_ws('|', '1234', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)))"


@query(
    f"""WITH s AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {DRAW}) AS rn FROM orders) WHERE rn <= 25)
    SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_DRAW}) AS rn
    FROM lineitem JOIN s ON l_orderkey = o_orderkey) WHERE rn = 1"""
)
def sample_reexpansion(t: Tables) -> DataFrame:
    """Sampled keys taken back to the full table, one row each."""
    keys = sample_per_stratum(orders(t), ["o_orderpriority"], 25).select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    # 25 rows for each of the fixed priorities
    return one_per_key(lines.join(F.broadcast(keys), "l_orderkey"), ["l_orderkey"])


SQL_UNMATCHED = """
corpus AS (SELECT DISTINCT w.work_id, domain, au.author_id, au.author_name, i.institution_name FROM works w
  JOIN authorships a ON w.work_id = a.work_id JOIN institutions i ON a.institution_id = i.institution_id LEFT JOIN authors au ON a.author_id = au.author_id
  LEFT JOIN primary_topic pt ON w.work_id = pt.work_id LEFT JOIN domains d ON pt.domain_id = d.domain_id
  WHERE publication_year >= 1997 AND type = 'article' AND doi <> '' AND country = 'NATION_3'
  AND length(w.title) > 15 AND w.work_id NOT IN (SELECT work_id FROM matches_a)),
flagged AS (SELECT work_id, domain, author_id, author_id IS NOT NULL AND author_id IN (SELECT author_id FROM crosswalk) AS author_known FROM corpus),
known AS (SELECT *, bool_or(author_known) OVER (PARTITION BY work_id) AS some_known FROM flagged)"""
CORPUS_ROLES = (*MATCH_ROLES, "authorships", "institutions", "authors", "crosswalk")
KNOWN_DRAW = """md5(concat_ws('|', '1234', CAST(work_id AS VARCHAR), domain, coalesce(CAST(author_id AS VARCHAR), ''), CAST(author_known AS VARCHAR), CAST(some_known AS VARCHAR)))"""


def known(t: Tables) -> DataFrame:
    rows = missing(t).select("work_id", "domain", "author_id", "author_name", "institution_name").distinct()
    return works_with_known_author(rows.select("work_id", "domain", "author_id"), roles.crosswalk(t))


@query(
    prelude(*CORPUS_ROLES).rstrip() + "," + SQL_UNMATCHED
    + f""" SELECT work_id, domain, author_id, author_known, some_known FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {KNOWN_DRAW}) AS rn
    FROM known WHERE author_known AND domain IS NOT NULL) WHERE rn <= 25"""
)
def known_author_check_sample(t: Tables) -> DataFrame:
    return known_author_sample(known(t))


@query(
    prelude(*CORPUS_ROLES).rstrip() + "," + SQL_UNMATCHED
    + f""" SELECT work_id, domain, author_id, author_known, some_known FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {KNOWN_DRAW}) AS rn
    FROM known WHERE NOT some_known AND domain IS NOT NULL) WHERE rn <= 25"""
)
def unknown_author_check_sample(t: Tables) -> DataFrame:
    return unknown_author_sample(known(t))


NATIONAL_COLUMNS = "article_id title publication_year specialty discipline first_name last_name institution identifier".split()
NATIONAL_DRAW = "md5(concat_ws('|', '1234', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in NATIONAL_COLUMNS) + "))"


@query(
    prelude("pubs", "meta", *NATIONAL_ROLES, "matches_b").rstrip()
    + f""",
    national AS ({NATIONAL}),
    drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {NATIONAL_DRAW}) AS rn FROM national) WHERE rn = 1),
    one AS (SELECT article_id, discipline, article_id IN (SELECT b.article_id FROM matches_b b WHERE b.doi IN (SELECT p.doi FROM pubs p)) AS matched FROM drawn),
    open AS (SELECT * FROM one WHERE NOT matched),
    counts AS (SELECT discipline AS s, count(*) AS n FROM open WHERE discipline IS NOT NULL GROUP BY 1),
    exact AS (SELECT s, n, n / sum(n) OVER () * 100 AS e FROM counts), r AS (SELECT *, round_even(e, 0) AS q FROM exact),
    k AS (SELECT CAST(100 - sum(q) AS BIGINT) AS missing FROM r),
    quota AS (SELECT s, CAST(q AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY (e - q) * sign(missing) DESC, s) <= abs(missing) THEN CAST(sign(missing) AS BIGINT) ELSE 0 END AS quota FROM r, k),
    chosen AS (SELECT article_id FROM (SELECT *, row_number() OVER (PARTITION BY discipline ORDER BY md5(concat_ws('|', '1234', CAST(article_id AS VARCHAR), discipline, CAST(matched AS VARCHAR)))) AS rn
      FROM open) JOIN quota ON s = discipline WHERE rn <= quota)
    SELECT article_id, first_name FROM drawn JOIN chosen USING (article_id)"""
)
def unmatched_article_check_sample(t: Tables) -> DataFrame:
    """Articles without a match, drawn from one random row per national article, then taken back to their full rows."""
    # read for the one row per article and for the full rows
    full = cut_lineage(national_index_articles(t).select(*NATIONAL_COLUMNS))
    listed = roles.matches_b(t).join(roles.pubs(t).select("doi").distinct(), "doi", "left_semi")
    flagged = flag_matched(one_per_key(full, ["article_id"]).select("article_id", "discipline"), listed, "article_id")
    return unmatched_article_sample(full, flagged).select("article_id", "first_name")


@query("SELECT quality, toxic, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM labels) AS p FROM labels GROUP BY ALL", doubles="p")
def checked_sample_results(t: Tables) -> DataFrame:
    """Annotations compiled: items per outcome and their share."""
    return result_shares(t.labels, ["quality", "toxic"], "doc_id")
