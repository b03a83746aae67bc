"""Tables derived from the publication list: cleaned titles, metadata, author names and group fractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.nulls import flag_label, is_filled, null_if_shorter
from pubmeter.functions.text import (
    BOILERPLATE,
    DOI_AT_LEAST,
    ISSN_AT_LEAST,
    TITLE_LONGER_THAN,
    clean_title,
    each,
    longer_than,
    split_name,
)
from pubmeter.operators.counting import distinct_counts, fractional_shares, share_within
from pubmeter.operators.membership import members, non_members
from pubmeter.operators.ordering import first_per_key
from pubmeter.operators.skew import skew_join

# Category codes of the inference table and the names used in results.
GENDERS = {"M": "Men", "F": "Women"}
BINARY = ("Women", "Men")


def clean_titles(
    articles: DataFrame, title: str = "title", keep: Sequence[str] = (), words: Sequence[str] = BOILERPLATE, min_length: int = TITLE_LONGER_THAN
) -> DataFrame:
    """``id`` (the raw title), ``keep`` columns and the cleaned title; short and empty ones are dropped."""
    cleaned = clean_title(F.col(title), words)
    # an array of the one cleaned title, if it is kept: a filter would clean every title once more per condition
    kept = F.filter(F.array(cleaned), lambda c: is_filled(c) & longer_than(c, min_length))
    return each(articles, kept, "title", F.col(title).alias("id"), *keep)


def text_table(pubs: DataFrame) -> DataFrame:
    """One cleaned row per raw title of the publication list."""
    articles = pubs.select("title", "year", "doi", "issn").distinct()
    return clean_titles(first_per_key(articles, ["title"], ["year", "doi", "issn"]), keep=["doi"])


def article_metadata(pubs: DataFrame, texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of ``columns`` per title of the text table; useless identifiers become null."""
    rows = members(pubs.select("title", *columns).distinct(), texts, "title", "id", pubs.select("title"))
    fixed = rows.withColumns(
        {
            "doi": null_if_shorter(F.nullif("doi", F.lit("")), DOI_AT_LEAST),
            "issn": null_if_shorter(F.col("issn"), ISSN_AT_LEAST),
        }
    )
    return first_per_key(fixed, ["title"], list(columns))


def author_names(pubs: DataFrame, country: str, as_published: bool = False) -> DataFrame:
    """``author_id, country, first_name, last_name`` of every named author."""
    people = pubs.select("author_id", "name").where(is_filled(F.col("name"))).distinct()
    first, last = split_name(F.col("name"), as_published=as_published)
    return people.select("author_id", F.lit(country).alias("country"), first.alias("first_name"), last.alias("last_name"))


def named_gender(gender: Column) -> Column:
    """Category name of a code; other values stay as they are."""
    named = gender
    for code, name in GENDERS.items():
        named = F.when(gender == code, name).otherwise(named)
    return named


def inferred_share(inference: DataFrame) -> DataFrame:
    """One row: share of the authors whose category is one of the two names."""
    binary = F.coalesce(named_gender(F.col("gender")).isin(*BINARY), F.lit(False))
    counts = distinct_counts(inference, [], "author_id", {"other": ~binary}, missing_counts=True)
    return counts.select((1 - F.try_divide("other", "n")).alias("share"))


def gender_fractions(pubs: DataFrame, inference: DataFrame) -> DataFrame:
    """``title, Women, Men``: share of each title's authors with an inferred category."""
    people = pubs.select("title", "author_id").distinct()
    known = inference.select("author_id", named_gender(F.col("gender")).alias("gender")).where(F.col("gender").isin(*BINARY)).distinct()
    # neither side has copies, so their join has none
    return fractional_shares(skew_join(people, known, "author_id", "inner", pubs.select("author_id")), "title", "author_id", "gender", BINARY, copies=False)


def without_fraction(pubs: DataFrame, fractions: DataFrame) -> DataFrame:
    """Publication rows whose title has no gendered author."""
    return non_members(pubs, fractions, "title", profile=pubs.select("title"))


def completeness(meta: DataFrame, key: str = "title") -> DataFrame:
    """``issn, journal, n``: articles by presence of an ISSN and of a journal name."""
    return distinct_counts(_presence(meta), ["issn", "journal"], key)


def completeness_by_year(meta: DataFrame, key: str = "title") -> DataFrame:
    """``cat, year, n, p``: the same combinations as a share of each year."""
    cat = F.concat("issn", F.lit(" & "), "journal")
    counts = distinct_counts(_presence(meta).withColumn("cat", cat), ["cat", "year"], key)
    return share_within(counts, "n", ["year"])


def _presence(meta: DataFrame) -> DataFrame:
    return meta.withColumns(
        {
            "issn": flag_label(F.col("issn").isNull(), "no ISSN", "has ISSN"),
            "journal": flag_label(F.col("journal").isNull(), "no journal name", "has journal name"),
        }
    )

