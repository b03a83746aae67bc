"""Matching of a publication list against bibliographic indexes, and the part of an index it lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.nulls import is_filled
from pubmeter.functions.text import (
    FIRST_YEAR,
    TITLE_LONGER_THAN,
    WORK_TITLE_LONGER_THAN,
    longer_than,
    normalise_doi,
    safe_int,
    squish,
    strip_quotes,
    year_from,
)
from pubmeter.operators.membership import non_members, with_flag
from pubmeter.operators.ordering import first_rows
from pubmeter.operators.sampling import one_per_key
from pubmeter.operators.skew import skew_join

# Identifier types that count as a DOI, and the document code of an article.
DOI_TYPES = ("doi", "xref_doi", "parent_book_doi")
ARTICLE_CODE = 1


def publication_list(pubs: DataFrame, first_year: int = FIRST_YEAR) -> DataFrame:
    """Rows with a title and an integer year of at least ``first_year``."""
    return pubs.where(is_filled(F.col("title")) & year_from(F.col("year"), first_year))


def primary_topics(work_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """``work_id, topic_id, domain_id``: each work's topic with the highest score, ties to the smaller topic id."""
    best = work_topics.join(topics.select("topic_id", "domain_id"), "topic_id")
    return first_rows(best, ["work_id"], [F.desc_nulls_last("score"), F.asc("topic_id")]).select(
        "work_id", "topic_id", "domain_id"
    )


def with_domain(works: DataFrame, topic_of_work: DataFrame, domains: DataFrame) -> DataFrame:
    """Works with the name of their topic's domain; works without topic keep a missing domain."""
    named = topic_of_work.join(domains.select("domain_id", "domain"), "domain_id", "left").select("work_id", "domain")
    return skew_join(works, named, "work_id", "left")


def match_by_doi(
    pubs: DataFrame,
    works: DataFrame,
    work_topics: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    first_year: int = FIRST_YEAR,
) -> DataFrame:
    """``doi, work_id, domain``: listed identifiers found in the index, letter case ignored."""
    listed = publication_list(pubs, first_year).where(is_filled(F.col("doi"))).select("doi", F.lower("doi").alias("_key")).distinct()
    indexed = works.where(is_filled(F.col("doi"))).select(F.lower("doi").alias("_key"), "work_id").distinct()
    # several works may carry one identifier, so the index is the side that can be hot
    found = skew_join(indexed, listed, "_key", "inner", works.select(F.lower("doi").alias("_key"))).select("doi", "work_id")
    return with_domain(found, primary_topics(work_topics, topics), domains).select("doi", "work_id", "domain").distinct()


def match_by_title(
    pubs: DataFrame,
    works: DataFrame,
    work_topics: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    first_year: int = FIRST_YEAR,
    primary_only: bool = False,
) -> DataFrame:
    """``title, year, work_id, domain``: listed titles found in the index under the same year.

    A work has one row per domain of any of its topics, unless ``primary_only``.
    """
    listed = publication_list(pubs, first_year).select("title", "year").distinct()
    keyed = listed.withColumn("publication_year", safe_int(F.col("year")))
    indexed = works.select("title", F.col("publication_year").cast("bigint").alias("publication_year"), "work_id").distinct()
    found = skew_join(indexed, keyed, ["title", "publication_year"], "inner", _title_years(works)).select("title", "year", "work_id")
    if primary_only:
        return with_domain(found, primary_topics(work_topics, topics), domains).distinct()
    known = topics.join(domains.select("domain_id", "domain"), "domain_id", "left").select("topic_id", "domain")
    pairs = work_topics.join(known, "topic_id", "left").select("work_id", "domain").distinct()
    return skew_join(found, pairs, "work_id", "left").select("title", "year", "work_id", "domain").distinct()


def _title_years(works: DataFrame) -> DataFrame:
    return works.select("title", F.col("publication_year").cast("bigint").alias("publication_year"))


def national_corpus(
    works: DataFrame,
    work_topics: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    authorships: DataFrame,
    institutions: DataFrame,
    authors: DataFrame,
    country: str,
    work_type: str = "article",
    first_year: int = FIRST_YEAR,
) -> DataFrame:
    """Index works of a country, one row per work, author and institution of that country."""
    kept = works.where(
        (F.col("publication_year") >= first_year) & (F.col("type") == work_type) & is_filled(F.col("doi"))
    ).select("work_id", "doi", "title", "publication_year")
    home = institutions.where(F.col("country") == country).select("institution_id", "institution_name", "institution_type")
    links = authorships.select("work_id", "author_id", "institution_id")
    local = skew_join(links, home, "institution_id", "inner", links).drop("institution_id").distinct()
    known = authors.select("author_id", F.col("author_id").alias("_known"), "author_name")
    named = skew_join(local, known, "author_id", "left", links).withColumn("author_id", F.col("_known")).drop("_known").distinct()
    rows = skew_join(named, kept, "work_id", "inner", links)
    return with_domain(rows, primary_topics(work_topics, topics), domains).distinct()


def not_matched(corpus: DataFrame, matches: DataFrame, key: str = "work_id", title: str = "title") -> DataFrame:
    """Rows of the corpus whose work has no match and a title long enough to be one."""
    long = corpus.where(longer_than(F.col(title), WORK_TITLE_LONGER_THAN))
    return non_members(long, matches, key)


def flag_matched(corpus: DataFrame, matches: DataFrame, key: str = "work_id") -> DataFrame:
    """The corpus with a flag for works that were matched."""
    return with_flag(corpus, matches, key, "matched")


def match_identifiers(dois: DataFrame, identifiers: DataFrame, articles: DataFrame, disciplines: DataFrame) -> DataFrame:
    """``doi, article_id, specialty, discipline``: listed identifiers found among an index's, of any type."""
    listed = dois.select("doi").distinct().withColumn("identifier", strip_quotes(F.col("doi"))).where(is_filled(F.col("identifier")))
    held = identifiers.select("identifier", "article_id").distinct()
    found = skew_join(held, listed, "identifier", "inner", identifiers.select("identifier")).select("doi", "article_id")
    return with_discipline(found, articles, disciplines).select("doi", "article_id", "specialty", "discipline").distinct()


def listed_matches(meta: DataFrame, identifiers: DataFrame, articles: DataFrame, disciplines: DataFrame) -> DataFrame:
    """``doi, article_id, specialty, discipline``: the corpus's identifiers, cleaned for the search, found in an index; one row each."""
    return one_per_key(match_identifiers(search_dois(meta), identifiers, articles, disciplines), ["doi"])


def match_article_titles(titles: DataFrame, articles: DataFrame, disciplines: DataFrame) -> DataFrame:
    """``title, year, article_id, specialty, discipline``: listed titles found under the same year."""
    listed = titles.where(is_filled(F.col("title")) & is_filled(F.col("year"))).select("title", "year").distinct()
    keyed = listed.withColumn("publication_year", safe_int(F.col("year")))
    held = articles.select("title", F.col("publication_year").cast("bigint").alias("publication_year"), "article_id", "discipline_code")
    found = skew_join(held, keyed, ["title", "publication_year"], "inner", _title_years(articles))
    named = found.join(disciplines.select("discipline_code", "specialty", "discipline"), "discipline_code", "left")
    return named.select("title", "year", "article_id", "specialty", "discipline").distinct()


def with_discipline(rows: DataFrame, articles: DataFrame, disciplines: DataFrame) -> DataFrame:
    """Rows with the discipline of their article, where it is known."""
    known = articles.select("article_id", "discipline_code").join(
        disciplines.select("discipline_code", "specialty", "discipline"), "discipline_code", "left"
    )
    return skew_join(rows, known.drop("discipline_code"), "article_id", "left")


def first_addresses(address_names: DataFrame) -> DataFrame:
    """``article_id, author_seq, address_no``: each author's first address on an article."""
    return address_names.groupBy("article_id", "author_seq").agg(F.min("address_no").alias("address_no"))


def national_articles(
    articles: DataFrame,
    identifiers: DataFrame,
    author_names: DataFrame,
    address_names: DataFrame,
    addresses: DataFrame,
    disciplines: DataFrame,
    country: str,
    first_year: int = FIRST_YEAR,
    types: Sequence[str] = DOI_TYPES,
    code: int = ARTICLE_CODE,
) -> DataFrame:
    """Articles with an author whose first address lies in the country, one row per author and identifier."""
    kept = articles.where((F.col("publication_year") >= first_year) & (F.col("document_code") == code))
    known = kept.join(disciplines.select("discipline_code", "specialty", "discipline"), "discipline_code", "left").select(
        "article_id", "title", "publication_year", "specialty", "discipline"
    )
    dois = identifiers.where(is_filled(F.col("identifier")) & F.col("type").isin(*types)).select("article_id", "identifier").distinct()
    at_home = addresses.where(F.col("country") == country).select("article_id", F.col("order").alias("address_no"), "institution")
    placed = first_addresses(address_names).join(at_home, ["article_id", "address_no"])
    # reduced before the wide joins: names, address and identifiers per article, without copies
    people = author_names.select("article_id", "author_seq", "first_name", "last_name").distinct()
    located = people.join(placed.drop("address_no"), ["article_id", "author_seq"]).drop("author_seq").distinct()
    rows = skew_join(located, known, "article_id", "inner", author_names.select("article_id"))
    return skew_join(rows, dois, "article_id", "inner", author_names.select("article_id")).distinct()


def author_crosswalk(links: DataFrame) -> DataFrame:
    """Distinct pairs of the two author identifiers."""
    return links.select("list_author", "author_id").distinct()


def search_titles(meta: DataFrame, title: str = "title", year: str = "year", longer: int = TITLE_LONGER_THAN) -> DataFrame:
    """``title, year``: distinct squished titles long enough to search for."""
    squished = meta.select(squish(F.col(title)).alias("title"), F.col(year).alias("year"))
    return squished.where(longer_than(F.col("title"), longer)).distinct()


def search_dois(meta: DataFrame, doi: str = "doi") -> DataFrame:
    """``doi``: distinct normalised identifiers to search for."""
    return meta.where(F.col(doi).isNotNull()).select(normalise_doi(F.col(doi)).alias("doi")).distinct()

