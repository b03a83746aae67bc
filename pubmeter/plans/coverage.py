"""Coverage, language, domain and group shares per topic, and the authors behind unmatched works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.nulls import not_in, zero_if_null
from pubmeter.functions.text import doi_key
from pubmeter.operators.counting import distinct_counts, dominant_category
from pubmeter.operators.membership import group_any, with_flag
from pubmeter.operators.sampling import one_per_key
from pubmeter.operators.skew import skew_join
from pubmeter.session import cut_lineage

# Topics left out of the analysis, and the share from which a domain is dominant.
OUTLIER_TOPICS = (637, 703, 193, 494)
DOMINANT_SHARE = 0.55
MIXED = "Multidisciplinary"
ENGLISH = "en"


def drop_topics(df: DataFrame, topics: Sequence[int] = OUTLIER_TOPICS, topic: str = "topic") -> DataFrame:
    """Without the listed topics; a missing topic stays."""
    return df.where(not_in(F.col(topic), topics))


def attach_match(doc_topic: DataFrame, meta: DataFrame, matches: DataFrame, compat: bool = False) -> DataFrame:
    """Documents with identifier and match, where they have them.

    Identifiers meet by their key, without prefix, quotes and case; of matches with one key one random row counts. With ``compat`` they must be spelled
    alike, as in the published study, where records searched for under a cleaned identifier cannot be found under their own.
    """
    with_doi = doc_topic.join(meta.select("id", "doi"), "id", "left")
    if compat:
        return skew_join(with_doi, matches, "doi", "left", meta.select("doi"))
    key = lambda df: df.withColumn("_doi", doi_key(F.col("doi")))
    single = one_per_key(key(matches).where(F.col("_doi").isNotNull()), ["_doi"]).drop("doi")
    return skew_join(key(with_doi), single, "_doi", "left", key(meta.select("doi")).select("_doi")).drop("_doi")


def coverage_by_topic(doc_topic: DataFrame, meta: DataFrame, matches: DataFrame, matched: str, compat: bool = False) -> DataFrame:
    """``topic, n_covered, n, p``: documents of each topic whose identifier was matched."""
    joined = attach_match(doc_topic, meta, matches, compat)
    return _share(distinct_counts(joined, ["topic"], "id", {"n_covered": F.col(matched).isNotNull()}), "n_covered")


def language_by_topic(doc_topic: DataFrame, language: DataFrame, value: str = ENGLISH, missing_counts: bool = True) -> DataFrame:
    """``topic, n_en, n, p``: documents of each topic in the given language."""
    joined = doc_topic.join(language.select("id", "language"), "id", "left")
    counts = distinct_counts(joined, ["topic"], "id", {"n_en": F.col("language") == value}, missing_counts=missing_counts)
    return _share(counts, "n_en")


def domain_of_topic(doc_topic: DataFrame, meta: DataFrame, matches: DataFrame, threshold: float = DOMINANT_SHARE) -> DataFrame:
    """``topic, domain``: the domain of most matched documents, or a mixed one."""
    joined = attach_match(doc_topic, meta, matches).where(F.col("domain").isNotNull())
    counts = distinct_counts(joined, ["topic", "domain"], "id")
    return dominant_category(counts, "topic", "domain", "n", threshold, MIXED)


def group_share_by_topic(doc_topic: DataFrame, fractions: DataFrame, group: str = "Women") -> DataFrame:
    """``topic, <group>, n``: mean fraction over the documents that have one, and the number of documents."""
    joined = doc_topic.join(fractions.select("id", group), "id", "left")
    # one mean per document first; a document is one row here, so the mean of sums is the mean of rows
    per_doc = joined.groupBy("topic", "id").agg(F.sum(group).alias("_s"), F.count(group).alias("_c"))
    mean = F.try_divide(F.sum("_s"), F.sum("_c"))
    return per_doc.groupBy("topic").agg(mean.alias(group), F.count(F.lit(1)).alias("n"))


def topic_features(
    coordinates: DataFrame, domain: DataFrame, info: DataFrame, coverage_a: DataFrame, coverage_b: DataFrame, language: DataFrame
) -> DataFrame:
    """One wide row per mapped topic; missing shares are zero. All inputs have one row per topic."""
    wide = (
        coordinates.join(domain, "topic", "left")
        .join(info.select("topic", "label", "count"), "topic", "left")
        .join(coverage_a.select("topic", F.col("p").alias("p_a")), "topic", "left")
        .join(coverage_b.select("topic", F.col("p").alias("p_b")), "topic", "left")
        .join(language.select("topic", F.col("p").alias("p_en")), "topic", "left")
    )
    return wide.withColumns({c: zero_if_null(F.col(c)) for c in ("p_en", "p_a", "p_b")})


def known_authors(corpus: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """``author_id, author_name, known``: distinct authors and whether the crosswalk holds them."""
    return with_flag(corpus.select("author_id", "author_name").distinct(), crosswalk, "author_id", "known")


def works_with_known_author(corpus: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """The corpus rows with ``author_known`` and, for the whole work, ``some_known``."""
    # read twice: for the flag of the work and for the rows
    flagged = cut_lineage(with_flag(corpus, crosswalk, "author_id", "author_known"))
    return group_any(flagged, "work_id", F.col("author_known"), "some_known", flagged.select("work_id"))


def work_counts(corpus: DataFrame, groups: Sequence[str], key: str = "work_id") -> DataFrame:
    """Distinct works per combination of columns."""
    return distinct_counts(corpus, groups, key)


def _share(counts: DataFrame, part: str, whole: str = "n") -> DataFrame:
    p: Column = F.try_divide(part, whole)
    return counts.withColumn("p", p)
