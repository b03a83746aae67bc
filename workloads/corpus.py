"""Metadata, coverage by topic and the reports on the analysis base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.counting import fractional_shares, frequency
from pubmeter.plans import coverage, metadata, reports
from workloads import roles
from workloads.registry import Tables, query
from workloads.statistics import STUDENT
from workloads.roles import BASE_ROLES, INDEX_ROLES, MATCH_ROLES, prelude

CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '[\p{{P}}\p{{S}}]', ' ', 'g'),
  'Author', ''), 'Reply', ''), 'Introduction', ''), 'Introdução', ''), 'Poster Sessions', ''), 'preparation', ''), '[\s\p{{Z}}]+', ' ', 'g'))"""
TEXTS = f"""texts AS (SELECT id, doi, title FROM (SELECT title AS id, doi, {CLEAN.format('title')} AS title FROM
  (SELECT title, doi, row_number() OVER (PARTITION BY title ORDER BY year, doi NULLS LAST, issn) AS rn FROM pubs) WHERE rn = 1) WHERE length(title) > 10)"""
META = """meta_rows AS (SELECT title, year, doi, journal, issn FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY year, doi NULLS LAST, journal NULLS LAST, issn NULLS LAST) AS rn
  FROM (SELECT DISTINCT title, year, CASE WHEN length(doi) >= 7 THEN doi END AS doi, journal, CASE WHEN length(issn) >= 3 THEN issn END AS issn
    FROM pubs WHERE title IN (SELECT id FROM texts))) WHERE rn = 1)"""


# --- metadata -----------------------------------------------------------------------------------------


@query(
    f"""SELECT md5(id) AS id, md5(title) AS title FROM (SELECT id, {CLEAN.format('id')} AS title FROM (SELECT DISTINCT text AS id FROM documents)) WHERE length(title) > 10"""
)
def cleaned_titles(t: Tables) -> DataFrame:
    """Whole texts as titles, one row per distinct text."""
    cleaned = metadata.clean_titles(t.documents.select("text").distinct(), "text")
    return cleaned.select(F.md5("id").alias("id"), F.md5("title").alias("title"))


@query(prelude("pubs").rstrip() + f", {TEXTS} SELECT * FROM texts")
def publication_text_table(t: Tables) -> DataFrame:
    return metadata.text_table(roles.pubs(t))


META_COLUMNS = ("year", "doi", "journal", "issn")


def article_meta(t: Tables) -> DataFrame:
    listed = roles.pubs(t)
    return metadata.article_metadata(listed, metadata.text_table(listed), META_COLUMNS)


@query(prelude("pubs").rstrip() + f", {TEXTS}, {META} SELECT * FROM meta_rows")
def article_metadata(t: Tables) -> DataFrame:
    return article_meta(t)


@query(
    prelude("pubs")
    + """SELECT DISTINCT author_id, 'Brazil' AS country, CASE WHEN name LIKE 'Ed %' THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 1) END AS first_name,
    CASE WHEN name LIKE 'Ed %' THEN nullif(regexp_replace(name, '^[^ ]* [^ ]* ?', ''), '') ELSE nullif(regexp_replace(name, '^[^ ]* ?', ''), '') END AS last_name
    FROM pubs WHERE name <> ''"""
)
def author_name_table(t: Tables) -> DataFrame:
    return metadata.author_names(roles.pubs(t), "Brazil")


@query(prelude("inference") + "SELECT count(DISTINCT author_id) FILTER (gender IN ('F', 'M')) / count(DISTINCT author_id) AS share FROM inference", doubles="share")
def inferred_gender_share(t: Tables) -> DataFrame:
    return metadata.inferred_share(roles.inference(t))


@query(
    prelude("pubs", "inference")
    + """SELECT title, count(*) FILTER (gender = 'F') / count(*) AS "Women", count(*) FILTER (gender = 'M') / count(*) AS "Men"
    FROM (SELECT DISTINCT title, p.author_id, gender FROM pubs p JOIN inference i ON p.author_id = i.author_id WHERE gender IN ('F', 'M')) GROUP BY title""",
    doubles="Women Men",
)
def fractional_gender(t: Tables) -> DataFrame:
    return metadata.gender_fractions(roles.pubs(t), roles.inference(t))


@query(
    """SELECT conv_id, count(DISTINCT turn) FILTER (role = 'user') / count(DISTINCT turn) AS "user", count(DISTINCT turn) FILTER (role = 'assistant') / count(DISTINCT turn) AS assistant
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
    doubles="user assistant",
)
def fractional_roles(t: Tables) -> DataFrame:
    return fractional_shares(t.conversations, "conv_id", "turn", "role", ["user", "assistant"])


@query(
    prelude("pubs", "inference")
    + """SELECT author_id, count(*) AS n FROM pubs WHERE title NOT IN (SELECT title FROM pubs p JOIN inference i ON p.author_id = i.author_id WHERE gender IN ('F', 'M')) GROUP BY 1"""
)
def rows_without_gender(t: Tables) -> DataFrame:
    listed = roles.pubs(t)
    rest = metadata.without_fraction(listed, metadata.gender_fractions(listed, roles.inference(t)))
    return rest.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    prelude("pubs").rstrip() + f", {TEXTS}, {META} "
    + """SELECT CASE WHEN issn IS NULL THEN 'no ISSN' ELSE 'has ISSN' END AS issn, CASE WHEN journal IS NULL THEN 'no journal name' ELSE 'has journal name' END AS journal,
    count(DISTINCT title) AS n FROM meta_rows GROUP BY ALL"""
)
def metadata_completeness(t: Tables) -> DataFrame:
    return metadata.completeness(article_meta(t))


@query(
    prelude("pubs").rstrip() + f", {TEXTS}, {META} "
    + """SELECT cat, year, n, n / sum(n) OVER (PARTITION BY year) AS p FROM (SELECT CASE WHEN issn IS NULL THEN 'no ISSN' ELSE 'has ISSN' END || ' & ' ||
    CASE WHEN journal IS NULL THEN 'no journal name' ELSE 'has journal name' END AS cat, year, count(DISTINCT title) AS n FROM meta_rows GROUP BY ALL)""",
    doubles="p",
)
def metadata_completeness_by_year(t: Tables) -> DataFrame:
    return metadata.completeness_by_year(article_meta(t))


# --- shares by topic ----------------------------------------------------------------------------------


@query(
    """SELECT topic, count(DISTINCT id) FILTER (quality = 1) AS n_covered, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (quality = 1) / count(DISTINCT id) AS p
    FROM (SELECT d.doc_id AS id, e.label AS topic, l.quality FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY topic""",
    doubles="p",
)
def coverage_by_topic(t: Tables) -> DataFrame:
    """Documents by topic, and those found in an index."""
    return coverage.coverage_by_topic(*label_corpus(t), "quality")


def label_corpus(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with topic, their metadata and the index entries of good quality."""
    topics = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("topic"))
    documents = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doi"))
    index = t.labels.where("quality = 1").select(F.col("doc_id").alias("doi"), "quality")
    return topics.join(documents.select("id"), "id", "left_semi"), documents, index


TOPIC_A = """
topic_a AS (SELECT topic, n_covered, n, n_covered / n AS p FROM (SELECT topic, count(DISTINCT CASE WHEN a.work_id IS NOT NULL THEN d.id END) AS n_covered, count(DISTINCT d.id) AS n
  FROM doc_topic d LEFT JOIN meta m ON d.id = m.id LEFT JOIN matches_a a ON m.doi = a.doi GROUP BY topic))"""
TOPIC_B = f"""
topic_b AS (SELECT topic, n_covered, n, n_covered / n AS p FROM (SELECT topic, count(DISTINCT CASE WHEN b.article_id IS NOT NULL THEN d.id END) AS n_covered, count(DISTINCT d.id) AS n
  FROM doc_topic d LEFT JOIN meta m ON d.id = m.id LEFT JOIN matches_b b ON {roles.doi_key_sql("m.doi")} = {roles.doi_key_sql("b.doi")} GROUP BY topic))"""
TOPIC_L = """
topic_l AS (SELECT topic, n_en, n, n_en / n AS p FROM (SELECT topic, count(DISTINCT CASE WHEN language = 'en' THEN d.id END) + max(CASE WHEN language IS NULL THEN 1 ELSE 0 END) AS n_en,
  count(DISTINCT d.id) AS n FROM doc_topic d LEFT JOIN language l ON d.id = l.id GROUP BY topic))"""
TOPIC_W = """
topic_w AS (SELECT topic, avg(Women) AS "Women", count(DISTINCT d.id) AS n FROM doc_topic d LEFT JOIN fractions f ON d.id = f.id GROUP BY topic)"""
ALL_ROLES = (*MATCH_ROLES, *INDEX_ROLES, "doc_topic", "meta", "language", "fractions", "topic_domain")


def with_topics(*parts: str) -> str:
    return prelude(*ALL_ROLES).rstrip() + ", " + ", ".join(parts) + " "


def topic_a(t: Tables) -> DataFrame:
    return coverage.coverage_by_topic(roles.doc_topic(t), roles.meta(t), roles.matches_a(t), "work_id")


def topic_b(t: Tables) -> DataFrame:
    return coverage.coverage_by_topic(roles.doc_topic(t), roles.meta(t), roles.matches_b(t), "article_id")


def topic_l(t: Tables) -> DataFrame:
    return coverage.language_by_topic(roles.doc_topic(t), roles.language(t))


def topic_w(t: Tables) -> DataFrame:
    return coverage.group_share_by_topic(roles.doc_topic(t), roles.fractions(t))


@query(with_topics(TOPIC_A) + "SELECT * FROM topic_a", doubles="p")
def index_a_coverage_by_topic(t: Tables) -> DataFrame:
    return topic_a(t)


@query(with_topics(TOPIC_B) + "SELECT * FROM topic_b", doubles="p")
def index_b_coverage_by_topic(t: Tables) -> DataFrame:
    return topic_b(t)


@query(with_topics(TOPIC_L) + "SELECT * FROM topic_l", doubles="p")
def english_share_by_topic(t: Tables) -> DataFrame:
    return topic_l(t)


@query(with_topics(TOPIC_W) + "SELECT * FROM topic_w", doubles="Women")
def women_share_by_topic(t: Tables) -> DataFrame:
    return topic_w(t)


@query(prelude(*ALL_ROLES) + "SELECT * FROM topic_domain")
def dominant_domain_by_topic(t: Tables) -> DataFrame:
    return roles.topic_domain(t)


@query(prelude("doc_topic") + "SELECT topic, count(*) AS n FROM doc_topic WHERE topic NOT IN (3, 11, 40) GROUP BY topic")
def topics_without_outliers(t: Tables) -> DataFrame:
    return coverage.drop_topics(roles.doc_topic(t), [3, 11, 40]).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# The map and the descriptions of the topics, derived from the corpus itself.
INFO = """
info AS (SELECT topic, topic || ' - Topic - ' || count(*) AS label, count(*) AS count FROM doc_topic GROUP BY topic),
coords AS (SELECT topic, CAST(topic % 10 AS DOUBLE) AS x, CAST(topic % 7 AS DOUBLE) AS y FROM (SELECT DISTINCT topic FROM doc_topic)),
features AS (SELECT c.topic, x, y, td.domain, i.label, i.count, coalesce(a.p, 0) AS p_a, coalesce(b.p, 0) AS p_b, coalesce(l.p, 0) AS p_en FROM coords c
  LEFT JOIN topic_domain td ON c.topic = td.topic LEFT JOIN info i ON c.topic = i.topic LEFT JOIN topic_a a ON c.topic = a.topic
  LEFT JOIN topic_b b ON c.topic = b.topic LEFT JOIN topic_l l ON c.topic = l.topic)"""


def info(t: Tables) -> DataFrame:
    counts = roles.doc_topic(t).groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("topic", F.concat("topic", F.lit(" - Topic - "), "count").alias("label"), "count")


def coords(t: Tables) -> DataFrame:
    x, y = ((F.col("topic") % n).cast("double") for n in (10, 7))
    return roles.doc_topic(t).select("topic").distinct().select("topic", x.alias("x"), y.alias("y"))


def features(t: Tables) -> DataFrame:
    return coverage.topic_features(coords(t), roles.topic_domain(t), info(t), topic_a(t), topic_b(t), topic_l(t))


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO) + "SELECT * FROM features", doubles="x y p_a p_b p_en")
def topic_feature_table(t: Tables) -> DataFrame:
    return features(t)


def _corr(name: str) -> str:
    return f"""SELECT '{name}' AS ind, count(*) AS n, corr(rx, ry) AS r FROM (SELECT rank() OVER (ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2 AS rx,
    rank() OVER (ORDER BY p_en) + (count(*) OVER (PARTITION BY p_en) - 1) / 2 AS ry FROM features)"""


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO) + f"SELECT ind, n, r FROM ({_corr('p_a')} UNION ALL {_corr('p_b')})", doubles="r")
def indexation_language_correlation(t: Tables) -> DataFrame:
    return reports.topic_correlations(features(t), ["p_a", "p_b"]).select("ind", "n", "r")


@query(
    with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO).rstrip()
    + f", tested AS (SELECT ind, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({_corr('p_a')} UNION ALL {_corr('p_b')})), {STUDENT.format('ind')}"
    + " SELECT ind, t, p AS p_value FROM tested JOIN tail USING (ind)",
    doubles="t p_value",
)
def indexation_language_tests(t: Tables) -> DataFrame:
    """The tests of both rank correlations; shares of topics are tied."""
    return reports.topic_correlations(features(t), ["p_a", "p_b"]).select("ind", "t", "p_value")


def _quadrants(part: str, what: str) -> str:
    return f"""SELECT c.topic, coalesce(w."Women", 0) AS "Women", coalesce(o.p, 0) AS p,
    CASE WHEN coalesce(w."Women", 0) >= mw AND coalesce(o.p, 0) >= mp THEN '1. High women authorship - High {what}'
      WHEN coalesce(w."Women", 0) >= mw AND coalesce(o.p, 0) < mp THEN '2. High women authorship - Low {what}'
      WHEN coalesce(w."Women", 0) < mw AND coalesce(o.p, 0) >= mp THEN '3. Low women authorship - High {what}'
      WHEN coalesce(w."Women", 0) < mw AND coalesce(o.p, 0) < mp THEN '4. Low women authorship - Low {what}' ELSE '3. Intermediate' END AS cluster
    FROM coords c LEFT JOIN topic_w w ON c.topic = w.topic LEFT JOIN {part} o ON c.topic = o.topic,
    (SELECT sum("Women" * n) / sum(n) FILTER ("Women" IS NOT NULL) AS mw FROM topic_w), (SELECT sum(p * n) / sum(n) AS mp FROM {part})"""


def quadrants(t: Tables, other: DataFrame, what: str) -> DataFrame:
    return reports.quadrant_classes(coords(t).select("topic"), topic_w(t), other, what)


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, TOPIC_W, INFO) + _quadrants("topic_l", "% English"), doubles="Women p")
def women_language_quadrants(t: Tables) -> DataFrame:
    return quadrants(t, topic_l(t), "% English")


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, TOPIC_W, INFO) + _quadrants("topic_a", "% A indexing"), doubles="Women p")
def women_index_a_quadrants(t: Tables) -> DataFrame:
    return quadrants(t, topic_a(t), "% A indexing")


@query(
    with_topics(TOPIC_A, TOPIC_B, TOPIC_L, TOPIC_W, INFO)
    + f"SELECT cluster, count(*) AS n FROM ({_quadrants('topic_b', '% B indexing')}) GROUP BY cluster"
)
def women_index_b_quadrant_counts(t: Tables) -> DataFrame:
    return frequency(quadrants(t, topic_b(t), "% B indexing"), "cluster")


def _extremes(part: str, measure: str) -> str:
    ranked = f"SELECT topic, regexp_replace(label, '^.* - ', '') AS label, {measure} AS m, rank() OVER (ORDER BY round({measure}, 12) {{0}} NULLS LAST) AS r FROM coords JOIN info USING (topic) LEFT JOIN {part} USING (topic)"
    return " UNION ALL ".join(f"SELECT topic, label, m AS {measure} FROM ({ranked.format(d)}) WHERE r <= 25" for d in ("DESC", "ASC"))


def extreme(t: Tables, part: DataFrame, measure: str) -> DataFrame:
    described = coords(t).select("topic").join(info(t), "topic").join(part.select("topic", measure), "topic", "left")
    return reports.extreme_topics(described, measure).select("topic", "label", measure)


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO) + _extremes("topic_a", "p"), doubles="p")
def extreme_topics_index_a(t: Tables) -> DataFrame:
    return extreme(t, topic_a(t), "p")


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO) + _extremes("topic_b", "p"), doubles="p")
def extreme_topics_index_b(t: Tables) -> DataFrame:
    return extreme(t, topic_b(t), "p")


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, INFO) + _extremes("topic_l", "p"), doubles="p")
def extreme_topics_language(t: Tables) -> DataFrame:
    return extreme(t, topic_l(t), "p")


@query(with_topics(TOPIC_A, TOPIC_B, TOPIC_L, TOPIC_W, INFO) + _extremes("topic_w", '"Women"'), doubles="Women")
def extreme_topics_women(t: Tables) -> DataFrame:
    return extreme(t, topic_w(t), "Women")


# --- reports on the base ------------------------------------------------------------------------------

BASE = prelude(*BASE_ROLES)


@query(BASE + 'SELECT id, topic, Women AS "Women", Men AS "Men", domain, language, in_a, in_b FROM base', doubles="Women Men")
def analysis_base_table(t: Tables) -> DataFrame:
    return roles.base(t)


def _weighted(gender: str, ind: str, condition: str) -> str:
    return f"SELECT '{gender}' AS gender, '{ind}' AS ind, sum({gender}) FILTER ({condition}) / sum({gender}) AS value FROM base"


@query(
    BASE
    + " UNION ALL ".join(
        _weighted(g, i, c)
        for g in ("Women", "Men")
        for i, c in (("% indexed in A", "in_a = 'Indexed'"), ("% indexed in B", "in_b = 'Indexed'"), ("% written in English", "language = 'English'"))
    ),
    doubles="value",
)
def weighted_coverage_by_gender(t: Tables) -> DataFrame:
    return reports.weighted_coverage(roles.base(t))


SHARES = """shares AS (SELECT indexation, n, n / sum(n) OVER () AS p FROM (SELECT CASE WHEN in_a = 'Indexed' AND in_b <> 'Indexed' THEN 'Only A' WHEN in_b = 'Indexed' AND in_a <> 'Indexed' THEN 'Only B'
  WHEN in_a = 'Indexed' AND in_b = 'Indexed' THEN 'A & B' ELSE 'Not indexed' END AS indexation, count(DISTINCT id) AS n FROM base GROUP BY 1))"""


@query(BASE.rstrip() + f", {SHARES} SELECT * FROM shares", doubles="p")
def indexation_categories(t: Tables) -> DataFrame:
    return reports.indexation_shares(roles.base(t))


@query(
    BASE.rstrip()
    + f""", {SHARES}, sizes AS (SELECT CASE c_nationkey % 3 WHEN 2 THEN 'B' ELSE 'A' END AS index, c_nationkey % 3 AS part, count(*) AS size FROM customer GROUP BY ALL),
    extra AS (SELECT index, sum(size * (CASE part WHEN 0 THEN 0.41 WHEN 1 THEN 0.26 ELSE 0.58 END + CASE part WHEN 0 THEN 0.01 WHEN 1 THEN 0.10 ELSE 0.26 END)) AS e FROM sizes GROUP BY 1)
    SELECT index, (CASE index WHEN 'A' THEN (SELECT sum(n) FROM shares WHERE indexation IN ('Only A', 'A & B')) ELSE (SELECT sum(n) FROM shares WHERE indexation IN ('Only B', 'A & B')) END + e)
      / (SELECT sum(n) FROM shares) AS bound FROM extra""",
    doubles="bound",
)
def coverage_upper_bounds(t: Tables) -> DataFrame:
    part = F.col("c_nationkey") % 3
    by_part = lambda a, b, c: F.when(F.col("part") == 0, a).when(F.col("part") == 1, b).otherwise(c)
    sizes = t.customer.groupBy(F.when(part == 2, "B").otherwise("A").alias("index"), part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    corpora = sizes.select("index", "size", by_part(0.41, 0.26, 0.58).alias("matched"), by_part(0.01, 0.10, 0.26).alias("not_covered"))
    return reports.upper_bounds(reports.indexation_shares(roles.base(t)), corpora)


def _english(name: str, condition: str) -> str:
    unknown = f"(SELECT max(CASE WHEN {condition} AND language IS NULL THEN 1 ELSE 0 END) FROM base)"
    return f"SELECT '{name}' AS indexation, (count(DISTINCT id) FILTER (language = 'English') + {unknown}) / count(DISTINCT id) AS p FROM base WHERE {condition}"


@query(
    BASE
    + " UNION ALL ".join(
        _english(n, c)
        for n, c in (("A", "in_a = 'Indexed'"), ("B", "in_b = 'Indexed'"), ("Not indexed", "in_a <> 'Indexed' AND in_b <> 'Indexed'"))
    ),
    doubles="p",
)
def english_share_by_indexation(t: Tables) -> DataFrame:
    return reports.language_by_indexation(roles.base(t))


def _over_under(flag: str, value: str) -> str:
    return f"""SELECT o.{flag}, o.domain, o.gender, o.p, n.p_norm, o.p / n.p_norm - 1 AS x FROM
    (SELECT {flag}, domain, gender, n / sum(n) OVER (PARTITION BY domain, gender) AS p FROM (SELECT {flag}, domain, 'Men' AS gender, sum(Men) AS n FROM base GROUP BY ALL
      UNION ALL SELECT {flag}, domain, 'Women', sum(Women) FROM base GROUP BY ALL)) o
    JOIN (SELECT {flag}, domain, n / sum(n) OVER (PARTITION BY domain) AS p_norm FROM (SELECT {flag}, domain, count(DISTINCT id) AS n FROM base GROUP BY ALL)) n
    ON o.{flag} = n.{flag} AND o.domain IS NOT DISTINCT FROM n.domain WHERE o.{flag} = '{value}'"""


@query(BASE + _over_under("in_a", "Indexed"), doubles="p p_norm x")
def over_under_index_a(t: Tables) -> DataFrame:
    return reports.over_under(roles.base(t), "in_a", "Indexed")


@query(BASE + _over_under("in_b", "Indexed"), doubles="p p_norm x")
def over_under_index_b(t: Tables) -> DataFrame:
    return reports.over_under(roles.base(t), "in_b", "Indexed")


@query(BASE + _over_under("language", "English"), doubles="p p_norm x")
def over_under_english(t: Tables) -> DataFrame:
    return reports.over_under(roles.base(t), "language", "English")


@query(
    BASE
    + """SELECT domain, gender, n, n / sum(n) OVER (PARTITION BY domain) AS p FROM (SELECT domain, 'Men' AS gender, sum(Men) AS n FROM base GROUP BY domain
    UNION ALL SELECT domain, 'Women', sum(Women) FROM base GROUP BY domain)""",
    doubles="n p",
)
def authorship_share_by_domain(t: Tables) -> DataFrame:
    return reports.authorship_by_domain(roles.base(t))


def _profile(ind: str, condition: str, place: int) -> str:
    return f"SELECT domain, '{ind}' AS ind, count(DISTINCT id) FILTER ({condition}) / count(DISTINCT id) AS value, {place} AS ord FROM base GROUP BY domain"


@query(
    BASE
    + " UNION ALL ".join(
        _profile(*p)
        for p in (
            ("% written in English", "language = 'English'", 1),
            ("% indexed in A", "in_a = 'Indexed'", 2),
            ("% indexed in B", "in_b = 'Indexed'", 3),
        )
    ),
    doubles="value",
)
def domain_profiles(t: Tables) -> DataFrame:
    return reports.domain_profile(roles.base(t))


@query(
    prelude("pubs", "inference")
    + """SELECT (SELECT count(*) FROM orders) AS documents, count(DISTINCT author_id) AS authors,
    (SELECT count(DISTINCT author_id) FROM inference WHERE gender IN ('F', 'M')) / count(DISTINCT author_id) AS inferred_share
    FROM pubs WHERE title IN (SELECT 'Study of order ' || o_orderkey FROM orders)""",
    doubles="inferred_share",
)
def corpus_size_checks(t: Tables) -> DataFrame:
    documents = t.orders.select(F.concat(F.lit("Study of order "), "o_orderkey").alias("id"))
    return reports.corpus_checks(documents, roles.pubs(t), roles.inference(t))


@query(
    """SELECT in_prev, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM (SELECT DISTINCT text, text IN (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) AS in_prev FROM documents) GROUP BY 1""",
    doubles="p",
)
def overlap_with_earlier_corpus(t: Tables) -> DataFrame:
    earlier = t.benchmark.select("text").unionByName(t.conversations.select("text"))
    return reports.overlap(t.documents, earlier, "text", "text")
