"""Matching against two indexes and the works that the list lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.sampling import one_per_key
from pubmeter.plans.coverage import known_authors, work_counts, works_with_known_author
from pubmeter.plans.matching import (
    author_crosswalk,
    flag_matched,
    match_article_titles,
    match_by_title,
    match_identifiers,
    national_articles,
    national_corpus,
    not_matched,
)
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import FIRST_YEAR, MATCH_ROLES, prelude

A_ROLES = ("pubs", "works", "work_topics", "topics", "domains", "primary_topic", "doi_matches")
CORPUS_ROLES = (*MATCH_ROLES, "authorships", "institutions", "authors", "crosswalk")

CORPUS = """
corpus AS (SELECT DISTINCT w.work_id, w.doi, d.domain, w.title, w.publication_year, au.author_id, au.author_name, i.institution_name, i.institution_type
  FROM works w JOIN authorships a ON w.work_id = a.work_id JOIN institutions i ON a.institution_id = i.institution_id
  LEFT JOIN authors au ON a.author_id = au.author_id LEFT JOIN primary_topic pt ON w.work_id = pt.work_id LEFT JOIN domains d ON pt.domain_id = d.domain_id
  WHERE publication_year >= 1997 AND type = 'article' AND doi <> '' AND country = 'NATION_3'),
missing AS (SELECT * FROM corpus WHERE length(title) > 15 AND work_id NOT IN (SELECT work_id FROM matches_a)),
flagged AS (SELECT *, coalesce(author_id IN (SELECT author_id FROM crosswalk), false) AS author_known FROM missing) """


def with_corpus() -> str:
    return prelude(*CORPUS_ROLES).rstrip() + "," + CORPUS


@query(prelude(*A_ROLES) + "SELECT * FROM doi_matches")
def match_index_by_doi(t: Tables) -> DataFrame:
    return roles.doi_matches(t)


@query(prelude(*MATCH_ROLES) + "SELECT * FROM matches_a")
def one_match_per_doi(t: Tables) -> DataFrame:
    return roles.matches_a(t)


TITLE_MATCHES = f"""
SELECT DISTINCT p.title, p.year, w.work_id, d.domain FROM pubs p
JOIN works w ON w.title = p.title AND w.publication_year = try_cast(p.year AS BIGINT)
LEFT JOIN work_topics wt ON w.work_id = wt.work_id LEFT JOIN topics t ON wt.topic_id = t.topic_id LEFT JOIN domains d ON t.domain_id = d.domain_id
WHERE p.title <> '' AND try_cast(p.year AS BIGINT) >= {FIRST_YEAR}"""


def title_matches(t: Tables) -> DataFrame:
    return match_by_title(roles.pubs(t), roles.works(t), roles.work_topics(t), roles.topics(t), roles.domains(t), FIRST_YEAR)


@query(prelude(*A_ROLES) + TITLE_MATCHES)
def match_index_by_title(t: Tables) -> DataFrame:
    """A work with topics of several domains has several rows."""
    return title_matches(t)


@query(
    prelude(*A_ROLES).rstrip()
    + f""", m AS ({TITLE_MATCHES}) SELECT title, year, work_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY title, year
    ORDER BY md5(concat_ws('|', '1234', title, year, CAST(work_id AS VARCHAR), coalesce(domain, '')))) AS rn FROM m) WHERE rn = 1"""
)
def one_match_per_title(t: Tables) -> DataFrame:
    return one_per_key(title_matches(t), ["title", "year"])


def corpus(t: Tables) -> DataFrame:
    return national_corpus(
        roles.works(t),
        roles.work_topics(t),
        roles.topics(t),
        roles.domains(t),
        roles.authorships(t),
        roles.institutions(t),
        roles.authors(t),
        roles.COUNTRY,
        first_year=FIRST_YEAR,
    )


@query(with_corpus() + "SELECT * FROM corpus")
def national_index_corpus(t: Tables) -> DataFrame:
    return corpus(t)


def missing(t: Tables) -> DataFrame:
    return not_matched(corpus(t), roles.matches_a(t))


@query(with_corpus() + "SELECT * FROM missing")
def national_works_not_matched(t: Tables) -> DataFrame:
    return missing(t)


@query(
    with_corpus()
    + """SELECT matched, count(DISTINCT work_id) AS n FROM (SELECT work_id, work_id IN (SELECT work_id FROM matches_a) AS matched FROM corpus WHERE length(title) > 15) GROUP BY 1"""
)
def matched_work_counts(t: Tables) -> DataFrame:
    long = corpus(t).where("char_length(title) > 15").select("work_id").distinct()
    return work_counts(flag_matched(long, roles.matches_a(t)), ["matched"])


@query(
    with_corpus()
    + """SELECT coalesce(length(doi) >= 5, false) AS has_doi, count(DISTINCT work_id) AS n FROM missing GROUP BY 1"""
)
def missing_works_with_doi(t: Tables) -> DataFrame:
    has = F.coalesce(F.char_length("doi") >= 5, F.lit(False))
    return work_counts(missing(t).withColumn("has_doi", has), ["has_doi"])


@query(with_corpus() + "SELECT institution_type, institution_name, count(DISTINCT work_id) AS n FROM missing GROUP BY ALL")
def missing_works_by_institution(t: Tables) -> DataFrame:
    return work_counts(missing(t), ["institution_type", "institution_name"])


@query(with_corpus() + "SELECT publication_year, count(DISTINCT work_id) AS n FROM missing GROUP BY ALL")
def missing_works_by_year(t: Tables) -> DataFrame:
    return work_counts(missing(t), ["publication_year"])


@query(with_corpus() + "SELECT domain, count(DISTINCT work_id) AS n FROM missing GROUP BY ALL")
def missing_works_by_domain(t: Tables) -> DataFrame:
    return work_counts(missing(t), ["domain"])


@query(with_corpus() + "SELECT DISTINCT author_id, author_name, author_known AS known FROM flagged")
def known_authors_of_missing_works(t: Tables) -> DataFrame:
    return known_authors(missing(t), roles.crosswalk(t))


@query(
    with_corpus()
    + "SELECT some_known, count(DISTINCT work_id) AS n FROM (SELECT work_id, bool_or(author_known) OVER (PARTITION BY work_id) AS some_known FROM flagged) GROUP BY 1"
)
def missing_works_with_known_author(t: Tables) -> DataFrame:
    return work_counts(works_with_known_author(missing(t), roles.crosswalk(t)), ["some_known"])


@query(prelude("crosswalk") + "SELECT DISTINCT list_author, author_id FROM crosswalk")
def author_id_crosswalk(t: Tables) -> DataFrame:
    return author_crosswalk(roles.crosswalk(t))


@query(
    prelude("pubs", "quoted_dois", "identifiers", "articles", "disciplines")
    + """SELECT DISTINCT l.doi, i.article_id, d.specialty, d.discipline FROM quoted_dois l JOIN identifiers i ON replace(replace(l.doi, '"', ''), '''', '') = i.identifier
    LEFT JOIN articles a ON i.article_id = a.article_id LEFT JOIN disciplines d ON a.discipline_code = d.discipline_code
    WHERE replace(replace(l.doi, '"', ''), '''', '') <> ''"""
)
def match_identifier_list(t: Tables) -> DataFrame:
    return match_identifiers(roles.quoted_dois(t), roles.identifiers(t), roles.articles(t), roles.disciplines(t))


@query(
    prelude("pubs", "articles", "disciplines")
    + """SELECT DISTINCT l.title, l.year, a.article_id, d.specialty, d.discipline FROM (SELECT DISTINCT title, year FROM pubs) l
    JOIN articles a ON l.title = a.title AND try_cast(l.year AS BIGINT) = a.publication_year LEFT JOIN disciplines d ON a.discipline_code = d.discipline_code
    WHERE l.title <> '' AND l.year <> ''"""
)
def match_title_list(t: Tables) -> DataFrame:
    return match_article_titles(roles.pubs(t), roles.articles(t), roles.disciplines(t))


NATIONAL_ROLES = ("articles", "disciplines", "identifiers", "author_names", "address_names", "addresses")
NATIONAL = """SELECT DISTINCT a.article_id, a.title, a.publication_year, d.specialty, d.discipline, n.first_name, n.last_name, ad.institution, i.identifier
    FROM articles a JOIN identifiers i ON i.article_id = a.article_id LEFT JOIN disciplines d ON a.discipline_code = d.discipline_code
    JOIN author_names n ON n.article_id = a.article_id
    JOIN (SELECT article_id, author_seq, min(address_no) AS address_no FROM address_names GROUP BY ALL) f ON f.article_id = a.article_id AND f.author_seq = n.author_seq
    JOIN addresses ad ON ad.article_id = a.article_id AND ad."order" = f.address_no
    WHERE a.publication_year >= 1997 AND ad.country = 'NATION_3' AND a.document_code = 1 AND i.identifier <> '' AND i.type IN ('doi', 'xref_doi', 'parent_book_doi')"""


@query(prelude(*NATIONAL_ROLES) + NATIONAL)
def national_index_articles(t: Tables) -> DataFrame:
    return national_articles(
        roles.articles(t),
        roles.identifiers(t),
        roles.author_names(t),
        roles.address_names(t),
        roles.addresses(t),
        roles.disciplines(t),
        roles.COUNTRY,
        FIRST_YEAR,
    )
