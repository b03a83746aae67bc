"""Analysis base table and the published statistics on it.

All reports read one base with a row per article that has a gendered author. They come from small aggregates
of it, so a study that needs several should write the base once and read it back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.nulls import flag_label, if_else, zero_if_null
from pubmeter.functions.text import after_last_dash, doi_key
from pubmeter.operators.counting import (
    distinct_counts,
    representation_ratio,
    share_of_total,
    share_where,
    share_within,
    unpivot_all,
)
from pubmeter.operators.membership import members, with_flag
from pubmeter.operators.ordering import extremes, level_order
from pubmeter.operators.skew import skew_join
from pubmeter.operators.statistics import mean_threshold, quadrant, spearman_by
from pubmeter.plans.metadata import BINARY, named_gender
from pubmeter.session import cut_lineage

# Names and orders of the categories in results.
DOMAINS = ("Physical Sciences", "Life Sciences", "Health Sciences", "Multidisciplinary", "Social Sciences")
INDEXED, NOT_INDEXED = "Indexed", "Not indexed"
ONLY_A, ONLY_B, BOTH, NEITHER = "Only A", "Only B", "A & B", "Not indexed"
INTERMEDIATE = "3. Intermediate"
MEASURES = ("% indexed in B", "% indexed in A", "% written in English")
EXTREMES = 25


def analysis_base(
    doc_topic: DataFrame,
    meta: DataFrame,
    fractions: DataFrame,
    domain: DataFrame,
    language: DataFrame,
    matches_a: DataFrame,
    matches_b: DataFrame,
    domains: Sequence[str] = DOMAINS,
    compat: bool = False,
) -> DataFrame:
    """``id, topic, Women, Men, domain, language, in_a, in_b`` of every article with a gendered author.

    A domain outside the list is missing, an unknown language stays missing, and an article without
    identifier is not indexed. Identifiers meet by their key, without prefix, quotes and case; with ``compat`` as they are spelled.
    """
    key = (lambda c: c) if compat else doi_key
    own = meta.select("id", key(F.col("doi")).alias("doi"))
    people = doc_topic.select("id", "topic").join(fractions.select("id", *BINARY), "id").where(F.col("Women").isNotNull())
    spoken = people.join(own, "id", "left").join(language.select("id", "language"), "id", "left")
    placed = skew_join(spoken, domain.select("topic", "domain"), "topic", "left", doc_topic.select("topic"))
    labelled = placed.withColumns(
        {
            "language": if_else(F.col("language") == "en", "English", "Other"),
            "domain": F.when(F.col("domain").isin(*domains), F.col("domain")),
        }
    )
    flagged = labelled
    for name, matches in (("in_a", matches_a), ("in_b", matches_b)):
        flagged = with_flag(flagged, matches.select(key(F.col("doi")).alias("doi")).where(F.col("doi").isNotNull()), "doi", name, profile=own.select("doi"))
        flagged = flagged.withColumn(name, flag_label(F.col(name), INDEXED, NOT_INDEXED))
    return flagged.drop("doi")


def indexed(column: str) -> Column:
    return F.col(column) == INDEXED


def indexation(a: str = "in_a", b: str = "in_b") -> Column:
    """Four classes of two flags."""
    return (
        F.when(indexed(a) & ~indexed(b), ONLY_A)
        .when(indexed(b) & ~indexed(a), ONLY_B)
        .when(indexed(a) & indexed(b), BOTH)
        .otherwise(NEITHER)
    )


def weighted_coverage(base: DataFrame, groups: Sequence[str] = BINARY) -> DataFrame:
    """``gender, ind, value``: part of each group's authorship that is indexed or in English; one pass."""
    conditions = {"% indexed in A": indexed("in_a"), "% indexed in B": indexed("in_b"), "% written in English": F.col("language") == "English"}
    columns = [share_where(F.col(g), c).alias(f"{g}|{name}") for g in groups for name, c in conditions.items()]
    long = unpivot_all(base.agg(*columns), [], "cell", "value")
    return long.select(F.split_part("cell", F.lit("|"), F.lit(1)).alias("gender"), F.split_part("cell", F.lit("|"), F.lit(2)).alias("ind"), "value")


def indexation_shares(base: DataFrame) -> DataFrame:
    """``indexation, n, p``: articles per class and their share."""
    return share_of_total(distinct_counts(base.withColumn("indexation", indexation()), ["indexation"], "id"), "n")


def upper_bounds(shares: DataFrame, corpora: DataFrame) -> DataFrame:
    """``index, bound``: coverage if checked samples speak for the corpora they were drawn from.

    ``corpora`` has one row per unmatched corpus: ``index`` it belongs to, ``size``, and the parts of it that
    were ``matched`` after all or are ``not_covered`` by the list. Both tables hold a handful of rows.
    """
    extra = corpora.groupBy("index").agg(F.sum(F.col("size") * (F.col("matched") + F.col("not_covered"))).alias("extra"))
    found = shares.agg(
        F.sum(F.when(F.col("indexation").isin(ONLY_A, BOTH), F.col("n")).otherwise(0)).alias("A"),
        F.sum(F.when(F.col("indexation").isin(ONLY_B, BOTH), F.col("n")).otherwise(0)).alias("B"),
        F.sum("n").alias("_total"),
    )
    long = found.unpivot(["_total"], ["A", "B"], "index", "_found")
    return long.join(extra, "index").select("index", ((F.col("_found") + F.col("extra")) / F.col("_total")).alias("bound"))


def language_by_indexation(base: DataFrame) -> DataFrame:
    """``indexation, p``: English part of the articles in each index and in none."""
    english = F.col("language") == "English"
    classes = {"A": indexed("in_a"), "B": indexed("in_b"), NEITHER: ~indexed("in_a") & ~indexed("in_b")}
    conditions = {}
    for i, c in enumerate(classes.values()):
        conditions[f"e{i}"], conditions[f"n{i}"] = c & english, c
    counts = distinct_counts(base, [], "id", conditions, total=None, missing_counts=True)
    wide = counts.select(*[F.try_divide(f"e{i}", f"n{i}").alias(name) for i, name in enumerate(classes)])
    return unpivot_all(wide, [], "indexation", "p")


def over_under(base: DataFrame, flag: str, value: str) -> DataFrame:
    """Observed over expected share of a flag value by domain and gender, minus one."""
    return representation_ratio(base, flag, value, "domain", "id", ["Men", "Women"])


def authorship_by_domain(base: DataFrame) -> DataFrame:
    """``domain, gender, n, p``: fractional authorship and its share in the domain."""
    sums = base.groupBy("domain").agg(F.sum("Men").alias("Men"), F.sum("Women").alias("Women"))
    return share_within(sums.unpivot(["domain"], ["Men", "Women"], "gender", "n"), "n", ["domain"])


def domain_profile(base: DataFrame) -> DataFrame:
    """``domain, ind, value, ord``: three shares of each domain's articles from one aggregate."""
    counts = distinct_counts(
        base, ["domain"], "id", {"a": indexed("in_a"), "b": indexed("in_b"), "e": F.col("language") == "English"}
    )
    shares = counts.select(
        "domain",
        F.when(F.col("e") > 0, F.col("e") / F.col("n")).alias(MEASURES[2]),
        F.when(F.col("a") > 0, F.col("a") / F.col("n")).alias(MEASURES[1]),
        F.when(F.col("b") > 0, F.col("b") / F.col("n")).alias(MEASURES[0]),
    )
    # a domain without any English article has no row to start from
    long = unpivot_all(shares.where(F.col(MEASURES[2]).isNotNull()), ["domain"], "ind", "value")
    return long.withColumn("ord", level_order(F.col("ind"), tuple(reversed(MEASURES))))


def quadrant_classes(topics: DataFrame, group_share: DataFrame, other_share: DataFrame, what: str) -> DataFrame:
    """Topics classed by women's share and another share, each against its weighted mean over all topics.

    ``group_share`` is (topic, Women, n), ``other_share`` (topic, p, n).
    """
    group_share, other_share = cut_lineage(group_share), cut_lineage(other_share)
    mid_w = mean_threshold(group_share, "Women", "n")
    mid_p = mean_threshold(other_share, "p", "n")
    # fixed values: names of the classes
    labels = (
        f"1. High women authorship - High {what}",
        f"2. High women authorship - Low {what}",
        f"3. Low women authorship - High {what}",
        f"4. Low women authorship - Low {what}",
    )
    wide = topics.join(group_share.select("topic", "Women"), "topic", "left").join(other_share.select("topic", "p"), "topic", "left")
    filled = wide.withColumns({"Women": zero_if_null(F.col("Women")), "p": zero_if_null(F.col("p"))})
    return filled.withColumn("cluster", quadrant(F.col("Women"), F.col("p"), mid_w, mid_p, labels, INTERMEDIATE))


def topic_correlations(features: DataFrame, measures: Sequence[str], against: str = "p_en") -> DataFrame:
    """``ind, n, r, s, t, p_value``: rank correlation of each measure with another, all measures in one pass."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("ind"), F.col(m).cast("double").alias("value")) for m in measures))).alias("m")
    long = features.select(F.col(against).alias("against"), rows).select("m.ind", "m.value", "against")
    return spearman_by(long, "ind", "value", "against")


def extreme_topics(topics: DataFrame, measure: str, n: int = EXTREMES) -> DataFrame:
    """The ``n`` highest and lowest topics by a measure, ties included, with short labels."""
    return extremes(cut_lineage(topics), measure, n).withColumn("label", after_last_dash(F.col("label")))


def corpus_checks(doc_topic: DataFrame, pubs: DataFrame, inference: DataFrame) -> DataFrame:
    """One row: documents, authors of kept titles, and inferred authors per kept author."""
    kept = members(pubs.select("title", "author_id").distinct(), doc_topic, "title", "id", pubs.select("title"))
    rows = doc_topic.agg(F.count(F.lit(1)).alias("n")).scalar()
    binary = F.coalesce(named_gender(F.col("gender")).isin(*BINARY), F.lit(False))
    inferred = distinct_counts(inference, [], "author_id", {"known": binary}, total=None)
    authors = distinct_counts(kept, [], "author_id", total="authors")
    return authors.select(rows.alias("documents"), "authors", F.try_divide(inferred.scalar(), "authors").alias("inferred_share"))


def overlap(doc_topic: DataFrame, previous: DataFrame, key: str = "id", previous_key: str = "title") -> DataFrame:
    """``in_prev, n, p``: documents that an earlier corpus held."""
    flagged = with_flag(doc_topic.select(key).distinct(), previous, key, "in_prev", previous_key)
    return share_of_total(distinct_counts(flagged, ["in_prev"], key), "n")
