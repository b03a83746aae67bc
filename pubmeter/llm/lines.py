"""Cross-site boilerplate lines: distinct sites by sketches, exact counts near the threshold. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.llm.common import keyed
from pubmeter.session import cut_lineage

# Sites from which on a line is boilerplate, and words from which on a line counts.
SITES = 5
WORDS = 5
# Share of all sites from which on a line of fewer words is boilerplate, where these count.
SHORT = 0.9
# Sketch size: 2**LG_K registers, relative error 1.04 / 2**(LG_K / 2).
LG_K = 11
# Lines whose estimate is this close to the threshold, in relative errors but at least one site, are counted exactly.
ERRORS = 5


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """``h1, h2, key, pos``: the lines seen at ``sites`` or more distinct sites, and where each stands first.

    ``lines`` has ``h1, h2, site, key, pos`` and is read more than once. Sketches of sites are made and merged by aggregation,
    partly in the map tasks. Only lines whose estimate is near the threshold are counted exactly, and lines that occur
    less often than ``sites`` times need no estimate.
    """
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"), F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("first")
    )
    spread = cut_lineage(sketched.where(F.col("n") >= sites).select("h1", "h2", "estimate", "first"))
    margin = max(1.0, ERRORS * 1.04 / 2 ** (lg_k / 2) * sites)
    near = F.abs(F.col("estimate") - sites) <= margin
    pairs = lines.join(spread.where(near).select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.where("site IS NOT NULL").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= sites)
    certain = spread.where(~near & (F.col("estimate") > sites))
    found = certain.select("h1", "h2", "first").unionByName(spread.where(near).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))
    return cut_lineage(found.select("h1", "h2", "first.key", "first.pos"))


def without_lines(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the sorted positions ``dropped``: the stretches between them, joined again."""
    lines = F.split(text, "\n")
    last = F.lit(-1).cast("int")
    starts = F.concat(F.array(last), dropped)
    stops = F.concat(dropped, F.array(F.size(lines)))
    stretches = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(stretches), "\n")


def drop_boilerplate(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, words: int = WORDS, lg_k: int = LG_K, short: float | None = None) -> DataFrame:
    """``docs`` with its columns and ``n_lines_removed``, the text without cross-site boilerplate lines.

    A line (between line feeds) of at least ``words`` words that stands at ``sites`` or more distinct sites is boilerplate: it
    stays where it comes first (smallest id, then position) and goes everywhere else, together with its line feed. Other
    lines stay as they are, and so does every row, even one whose text becomes empty. With ``short``, a line of fewer words,
    but at least one, counts too: it is boilerplate at ``sites`` or more sites that are at least this share of all sites.

    A missing text stays missing, a missing site is no site, repeated rows are rows of their own. An empty table stays empty.
    Lines are known by 128 bits of hash. Only line hashes and positions are shuffled by line; a line that a third of all rows
    share is combined in the map tasks and split by adaptive execution in the join.
    """
    names = docs.columns
    rows = keyed(docs, id, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    value = F.col("row").getField(text)
    exploded = rows.select("key", F.col("row").getField(site).alias("site"), F.posexplode(F.split(value, "\n")).alias("pos", "line"))
    filled = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    long_enough = F.col("line").rlike(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{words - 1}}}[^\x20\x09-\x0D]") if words > 1 else filled
    hashed = ["key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    if short is None:
        lines = cut_lineage(exploded.where(long_enough).select(*hashed))
        found = boilerplate(lines, sites, lg_k)
    else:
        lines = cut_lineage(exploded.where(filled).select(*hashed, long_enough.alias("long")))
        wide = max(sites, math.ceil(short * docs.agg(F.count_distinct(F.col(f"`{site}`"))).first()[0]))
        found = boilerplate(lines.where("long"), sites, lg_k).unionByName(boilerplate(lines.where("NOT long"), wide, lg_k))
    found = found.withColumnsRenamed({"key": "first_key", "pos": "first_pos"})
    flagged = lines.join(found, ["h1", "h2"]).where("key <> first_key OR pos <> first_pos")
    dropped = cut_lineage(flagged.groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("dropped")))
    # texts and positions meet in a merge join at every size, so the amount that moves is in proportion to the input
    joined = rows.join(dropped.hint("merge"), "key", "left")
    cleaned = F.when(F.col("dropped").isNull(), value).otherwise(without_lines(value, F.col("dropped")))
    removed = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    out = [cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names if c != "n_lines_removed"]
    return joined.select(*out, F.when(F.col("dropped").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_lines_removed"))
