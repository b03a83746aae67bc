"""The parts that the supplied tables play: publication list, two indexes, corpus, topics and vectors.

Each role is a projection or join of whole tables; ``SQL`` holds the same definitions for the counterpart
queries. Keys give the missing values, odd spellings and duplicates that the supplied columns lack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.sampling import one_per_key
from pubmeter.plans.coverage import domain_of_topic
from pubmeter.plans.matching import listed_matches, match_by_doi
from pubmeter.plans.metadata import gender_fractions
from pubmeter.plans.reports import analysis_base
from workloads.registry import Tables

FIRST_YEAR = 1997
COUNTRY = "NATION_3"
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")

SQL: dict[str, str] = {}


def prelude(*names: str) -> str:
    """``WITH`` clause of the named roles."""
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in dict.fromkeys(names)) + " "


def mod(column: str, n: int) -> Column:
    return F.col(column) % n


def year_of(column: str) -> Column:
    return F.year(column)


# --- publication list: one row per article and author -------------------------------------------------

SQL["pubs"] = """
SELECT l_suppkey AS author_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'Ed Carlos N' || l_suppkey WHEN 1 THEN 'Ana' WHEN 2 THEN 'Maria Silva N' || l_suppkey ELSE '' END AS name,
  'Study of order ' || l_orderkey AS title,
  CASE WHEN l_orderkey % 11 = 0 THEN 'n/d' ELSE ' ' || year(l_shipdate) END AS year,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN '10.1/x'
    ELSE '10.55/ORD.' || l_orderkey END AS doi,
  CASE WHEN l_partkey % 6 = 0 THEN '-' ELSE '1234-' || l_partkey % 100 END AS issn,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 'Journal ' || l_partkey % 50 END AS journal
FROM lineitem"""


def pubs(t: Tables) -> DataFrame:
    s, o, p = "l_suppkey", "l_orderkey", "l_partkey"
    kind = mod(s, 4)
    name = (
        F.when(kind == 0, F.concat(F.lit("Ed Carlos N"), s)).when(kind == 1, "Ana").when(kind == 2, F.concat(F.lit("Maria Silva N"), s)).otherwise("")
    )
    return t.lineitem.select(
        F.col(s).alias("author_id"),
        name.alias("name"),
        F.concat(F.lit("Study of order "), o).alias("title"),
        F.when(mod(o, 11) == 0, "n/d").otherwise(F.concat(F.lit(" "), year_of("l_shipdate"))).alias("year"),
        pub_doi(o).alias("doi"),
        F.when(mod(p, 6) == 0, "-").otherwise(F.concat(F.lit("1234-"), mod(p, 100))).alias("issn"),
        F.when(mod(p, 9) != 0, F.concat(F.lit("Journal "), mod(p, 50))).alias("journal"),
    )


def pub_doi(key: str) -> Column:
    return (
        F.when(mod(key, 13) == 0, None).when(mod(key, 7) == 0, "").when(mod(key, 17) == 0, "10.1/x").otherwise(F.concat(F.lit("10.55/ORD."), key))
    )


SQL["inference"] = """
SELECT s_suppkey AS author_id, CASE s_suppkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'unknown' END AS gender FROM supplier"""


def inference(t: Tables) -> DataFrame:
    kind = mod("s_suppkey", 3)
    gender = F.when(kind == 0, "F").when(kind == 1, "M").otherwise("unknown")
    return t.supplier.select(F.col("s_suppkey").alias("author_id"), gender.alias("gender"))


# --- index A: works, scored topics, domains, authorships ----------------------------------------------

SQL["works"] = """
SELECT o_orderkey AS work_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '10.55/ord.' || (o_orderkey // 2) * 2 END AS doi,
  'Study of order ' || o_orderkey AS title, year(o_orderdate) AS publication_year,
  CASE WHEN o_orderstatus = 'P' THEN 'book' ELSE 'article' END AS type
FROM orders"""


def works(t: Tables) -> DataFrame:
    even = F.expr("(o_orderkey div 2) * 2")
    return t.orders.select(
        F.col("o_orderkey").alias("work_id"),
        F.when(mod("o_orderkey", 9) != 0, F.concat(F.lit("10.55/ord."), even)).alias("doi"),
        F.concat(F.lit("Study of order "), "o_orderkey").alias("title"),
        year_of("o_orderdate").alias("publication_year"),
        F.when(F.col("o_orderstatus") == "P", "book").otherwise("article").alias("type"),
    )


SQL["work_topics"] = "SELECT l_orderkey AS work_id, l_partkey AS topic_id, l_quantity AS score FROM lineitem"


def work_topics(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("topic_id"), F.col("l_quantity").alias("score"))


SQL["topics"] = "SELECT p_partkey AS topic_id, p_name AS topic, p_size % 6 AS domain_id FROM part"


def topics(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("topic"), mod("p_size", 6).alias("domain_id"))


SQL["domains"] = "SELECT r_regionkey AS domain_id, r_name AS domain FROM region"


def domains(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("domain_id"), F.col("r_name").alias("domain"))


SQL["authorships"] = "SELECT l_orderkey AS work_id, l_partkey AS author_id, l_suppkey AS institution_id FROM lineitem"


def authorships(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("author_id"), F.col("l_suppkey").alias("institution_id")
    )


SQL["institutions"] = """
SELECT s_suppkey AS institution_id, s_name AS institution_name,
  CASE WHEN s_acctbal > 5000 THEN 'education' ELSE 'company' END AS institution_type, n_name AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def institutions(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("institution_id"),
        F.col("s_name").alias("institution_name"),
        F.when(F.col("s_acctbal") > 5000, "education").otherwise("company").alias("institution_type"),
        F.col("n_name").alias("country"),
    )


SQL["authors"] = "SELECT c_custkey AS author_id, c_name AS author_name FROM customer"


def authors(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_name"))


SQL["crosswalk"] = "SELECT c_nationkey AS list_author, c_custkey AS author_id FROM customer"


def crosswalk(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("list_author"), F.col("c_custkey").alias("author_id"))


# --- index B: articles, identifiers, names, addresses -------------------------------------------------

SQL["articles"] = """
SELECT o_orderkey AS article_id, 'Study of order ' || o_orderkey AS title, year(o_orderdate) AS publication_year,
  o_custkey % 30 AS discipline_code, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS document_code
FROM orders"""


def articles(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("article_id"),
        F.concat(F.lit("Study of order "), "o_orderkey").alias("title"),
        year_of("o_orderdate").alias("publication_year"),
        mod("o_custkey", 30).alias("discipline_code"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("document_code"),
    )


SQL["identifiers"] = """
SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE '10.55/ORD.' || o_orderkey END AS identifier,
  CASE o_orderkey % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'xref_doi' WHEN 2 THEN 'pmid' ELSE 'parent_book_doi' END AS type
FROM orders"""


def identifiers(t: Tables) -> DataFrame:
    kind = mod("o_orderkey", 4)
    return t.orders.select(
        F.col("o_orderkey").alias("article_id"),
        F.when(mod("o_orderkey", 10) == 9, "").otherwise(F.concat(F.lit("10.55/ORD."), "o_orderkey")).alias("identifier"),
        F.when(kind == 0, "doi").when(kind == 1, "xref_doi").when(kind == 2, "pmid").otherwise("parent_book_doi").alias("type"),
    )


SQL["disciplines"] = """
SELECT n_nationkey AS discipline_code, n_name AS specialty, r_name AS discipline FROM nation JOIN region ON n_regionkey = r_regionkey"""


def disciplines(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("discipline_code"), F.col("n_name").alias("specialty"), F.col("r_name").alias("discipline")
    )


SQL["quoted_dois"] = """
SELECT DISTINCT CASE WHEN doi = '' THEN '""' WHEN length(doi) % 2 = 0 THEN '"' || doi || '"' ELSE '''' || doi || '''' END AS doi
FROM pubs WHERE doi IS NOT NULL"""


def quoted_dois(t: Tables) -> DataFrame:
    doi = F.col("doi")
    quoted = F.when(doi == "", '""').when(F.length(doi) % 2 == 0, F.concat(F.lit('"'), doi, F.lit('"'))).otherwise(F.concat(F.lit("'"), doi, F.lit("'")))
    return pubs(t).where(doi.isNotNull()).select(quoted.alias("doi")).distinct()


SQL["author_names"] = """
SELECT l_orderkey AS article_id, l_linenumber AS author_seq, 'F' || l_suppkey AS first_name, 'L' || l_partkey % 40 AS last_name FROM lineitem"""


def author_names(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("article_id"),
        F.col("l_linenumber").alias("author_seq"),
        F.concat(F.lit("F"), "l_suppkey").alias("first_name"),
        F.concat(F.lit("L"), mod("l_partkey", 40)).alias("last_name"),
    )


SQL["address_names"] = "SELECT l_orderkey AS article_id, l_linenumber AS author_seq, l_suppkey % 5 + 1 AS address_no FROM lineitem"


def address_names(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("author_seq"), (mod("l_suppkey", 5) + 1).alias("address_no")
    )


SQL["addresses"] = """
SELECT l_orderkey AS article_id, l_suppkey % 5 + 1 AS "order", s_name AS institution, n_name AS country
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def addresses(t: Tables) -> DataFrame:
    places = institutions(t).select(F.col("institution_id").alias("l_suppkey"), F.col("institution_name").alias("institution"), "country")
    return t.lineitem.join(places, "l_suppkey").select(
        F.col("l_orderkey").alias("article_id"), (mod("l_suppkey", 5) + 1).alias("order"), "institution", "country"
    )


# --- corpus: documents with topic, metadata, language -------------------------------------------------

SQL["doc_topic"] = "SELECT o_orderkey AS id, o_custkey % 97 AS topic FROM orders"


def doc_topic(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), mod("o_custkey", 97).alias("topic"))


SQL["meta"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '10.1/x'
    ELSE '10.55/ORD.' || o_orderkey END AS doi FROM orders"""


def meta(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), pub_doi("o_orderkey").alias("doi"))


SQL["language"] = """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'en' WHEN '2-HIGH' THEN 'en' WHEN '3-MEDIUM' THEN 'pt' WHEN '5-LOW' THEN 'es' END AS language
FROM orders"""


def language(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    code = F.when(p.isin("1-URGENT", "2-HIGH"), "en").when(p == "3-MEDIUM", "pt").when(p == "5-LOW", "es")
    return t.orders.select(F.col("o_orderkey").alias("id"), code.alias("language"))


SQL["fractions"] = """
SELECT id, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) / count(*) AS Women, sum(CASE WHEN g = 1 THEN 1 ELSE 0 END) / count(*) AS Men
FROM (SELECT DISTINCT l_orderkey AS id, s_suppkey, s_suppkey % 3 AS g FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 3 < 2)
GROUP BY id"""


def fractions(t: Tables) -> DataFrame:
    people = t.lineitem.select(F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("author_id"))
    return gender_fractions(people, inference(t)).withColumnRenamed("title", "id")


SQL["primary_topic"] = """
SELECT work_id, topic_id, domain_id FROM (
  SELECT work_id, w.topic_id, domain_id, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, w.topic_id) AS rn
  FROM work_topics w JOIN topics t ON w.topic_id = t.topic_id) WHERE rn = 1"""

SQL["doi_matches"] = f"""
SELECT DISTINCT p.doi, w.work_id, d.domain
FROM pubs p JOIN works w ON lower(w.doi) = lower(p.doi)
LEFT JOIN primary_topic pt ON w.work_id = pt.work_id LEFT JOIN domains d ON pt.domain_id = d.domain_id
WHERE p.title <> '' AND try_cast(p.year AS BIGINT) >= {FIRST_YEAR} AND p.doi <> '' AND w.doi <> ''"""


def doi_matches(t: Tables) -> DataFrame:
    return match_by_doi(pubs(t), works(t), work_topics(t), topics(t), domains(t), FIRST_YEAR)


SQL["matches_a"] = """
SELECT doi, work_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY
  md5(concat_ws('|', '1234', doi, CAST(work_id AS VARCHAR), coalesce(domain, '')))) AS rn FROM doi_matches) WHERE rn = 1"""


def matches_a(t: Tables) -> DataFrame:
    return one_per_key(doi_matches(t), ["doi"])


def doi_key_sql(c: str) -> str:
    """Join key of an identifier in SQL: no quotes, blanks, prefix or upper case."""
    bare = f"""trim(regexp_replace(replace(replace({c}, '"', ''), chr(39), ''), '\\s+', ' ', 'g'))"""
    return f"nullif(lower(trim(regexp_replace(regexp_replace({bare}, '^doi:', ''), '^DOI:', ''))), '')"


# The corpus's identifiers without blanks and prefix, searched for among the index's by their spelling without quotes.
SQL["matches_b"] = r"""
SELECT doi, article_id, specialty, discipline FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY
  md5(concat_ws('|', '1234', doi, CAST(article_id AS VARCHAR), coalesce(specialty, ''), coalesce(discipline, '')))) AS rn
  FROM (SELECT DISTINCT l.doi, i.article_id, d.specialty, d.discipline
    FROM (SELECT DISTINCT trim(regexp_replace(regexp_replace(trim(regexp_replace(doi, '\s+', ' ', 'g')), '^doi:', ''), '^DOI:', '')) AS doi FROM meta WHERE doi IS NOT NULL) l
    JOIN identifiers i ON replace(replace(l.doi, '"', ''), '''', '') = i.identifier
    LEFT JOIN articles a ON i.article_id = a.article_id LEFT JOIN disciplines d ON a.discipline_code = d.discipline_code
    WHERE replace(replace(l.doi, '"', ''), '''', '') <> '')) WHERE rn = 1"""


def matches_b(t: Tables) -> DataFrame:
    return listed_matches(meta(t), identifiers(t), articles(t), disciplines(t))


MATCH_ROLES = ("pubs", "works", "work_topics", "topics", "domains", "primary_topic", "doi_matches", "matches_a")
INDEX_ROLES = ("meta", "identifiers", "articles", "disciplines", "matches_b")

SQL["topic_domain"] = """
SELECT topic, CASE WHEN max(n) / sum(n) < 0.55 THEN 'Multidisciplinary' ELSE arg_max(domain, n) END AS domain FROM (
  SELECT topic, a.domain, count(DISTINCT d.id) AS n FROM doc_topic d JOIN meta m ON d.id = m.id JOIN matches_a a ON m.doi = a.doi
  WHERE a.domain IS NOT NULL GROUP BY ALL) GROUP BY topic"""


def topic_domain(t: Tables) -> DataFrame:
    return domain_of_topic(doc_topic(t), meta(t), matches_a(t))


# Few topics of the supplied tables have one domain above the threshold, so the base gives every topic one by its
# number, with one domain outside the list.
SQL["topic_segment"] = "SELECT topic, CASE topic % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'ELSEWHERE' END AS domain FROM (SELECT DISTINCT topic FROM doc_topic)"


def topic_segment(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(r) for r in (*REGIONS, "ELSEWHERE")]), (mod("topic", 5) + 1).cast("int"))
    return doc_topic(t).select("topic").distinct().withColumn("domain", name)


SQL["base"] = f"""
SELECT d.id, d.topic, f.Women, f.Men, CASE WHEN s.domain IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN s.domain END AS domain,
  CASE WHEN l.language = 'en' THEN 'English' WHEN l.language IS NOT NULL THEN 'Other' END AS language,
  CASE WHEN {doi_key_sql("m.doi")} IN (SELECT {doi_key_sql("doi")} FROM matches_a) THEN 'Indexed' ELSE 'Not indexed' END AS in_a,
  CASE WHEN {doi_key_sql("m.doi")} IN (SELECT {doi_key_sql("doi")} FROM matches_b) THEN 'Indexed' ELSE 'Not indexed' END AS in_b
FROM doc_topic d JOIN fractions f ON d.id = f.id LEFT JOIN meta m ON d.id = m.id LEFT JOIN language l ON d.id = l.id
LEFT JOIN topic_segment s ON d.topic = s.topic"""

BASE_ROLES = (*MATCH_ROLES, *INDEX_ROLES, "doc_topic", "meta", "language", "fractions", "topic_segment", "base")


def base(t: Tables) -> DataFrame:
    return analysis_base(doc_topic(t), meta(t), fractions(t), topic_segment(t), language(t), matches_a(t), matches_b(t), REGIONS)


# --- texts and vectors --------------------------------------------------------------------------------

SQL["vectors"] = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS topic FROM embeddings"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("topic"))


SQL["centroids"] = """
SELECT topic, list(m ORDER BY pos) AS vec FROM (
  SELECT topic, pos, avg(x) AS m FROM (SELECT topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vectors) GROUP BY topic, pos)
GROUP BY topic"""
