"""Samples for manual checks, and the tables compiled from the checked samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.counting import distinct_counts, share_of_total
from pubmeter.operators.sampling import SEED, one_per_key, proportional_sample, sample_per_stratum
from pubmeter.session import cut_lineage

# Rows per stratum and size of the proportional sample.
PER_DOMAIN = 25
SAMPLE_SIZE = 100


def known_author_sample(corpus: DataFrame, k: int = PER_DOMAIN, seed: int = SEED) -> DataFrame:
    """Rows per domain whose author is known."""
    return sample_per_stratum(corpus.where("author_known").where(F.col("domain").isNotNull()), ["domain"], k, seed)


def unknown_author_sample(corpus: DataFrame, k: int = PER_DOMAIN, seed: int = SEED) -> DataFrame:
    """Rows per domain of works without any known author."""
    return sample_per_stratum(corpus.where("not some_known").where(F.col("domain").isNotNull()), ["domain"], k, seed)


def unmatched_article_sample(
    rows: DataFrame,
    matched: DataFrame,
    stratum: str = "discipline",
    key: str = "article_id",
    size: int = SAMPLE_SIZE,
    manual: Mapping[str, int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Articles without a match, in proportion to the strata, each with one of its full rows.

    ``rows`` holds several rows per article, ``matched`` one row per article with the flag ``matched``.
    """
    # read for the quotas and for the draw
    open_ones = cut_lineage(matched.where("not matched").select(key, stratum, "matched"))
    chosen = proportional_sample(open_ones, stratum, key, size, manual, seed)
    # at most ``size`` articles, plus manual corrections
    full = rows.join(F.broadcast(chosen.select(key)), key)
    return one_per_key(full, [key], seed)


def result_shares(checked: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    """Distinct items per outcome, and their share of all."""
    return share_of_total(distinct_counts(checked, groups, key), "n")
