"""Language of a text by its letter triples: profiles are learned with counts and applied with one join.

For scoring, a profile has one row per triple with the values of all languages, and a text's sums are formed place by place.
Log probabilities are whole numbers of millionths: their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.text import each
from pubmeter.session import cut_lineage

SCALE = 1_000_000
# Bytes of a profile that every executor may hold; a larger one is joined by shuffling counted triples.
HELD_BYTES = 64 << 20


def words_of(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` columns and ``word``, one row per run of letters of the lower-cased text."""
    return each(df, F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)), "word", *keep)


def triples_of(words: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``triple``: all triples of neighbouring letters of each ``word``, padded by one blank on either side."""
    padded = words.select(*keep, F.concat(F.lit(" "), "word", F.lit(" ")).alias("_padded"), F.char_length("word").alias("_size"))
    placed = padded.select(*keep, "_padded", F.explode(F.sequence(F.lit(1), "_size")).alias("_at"))
    return placed.select(*keep, F.expr("substring(_padded, _at, 3)").alias("triple"))


def language_profile(labelled: DataFrame, text: str, language: str) -> DataFrame:
    """``language, triple, logp``: smoothed log probabilities of every triple in every language. Rows without label teach nothing."""
    known = labelled.where(F.col(language).isNotNull())
    # different words are few beside all words
    words = words_of(known, text, F.col(language).alias("language")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("_c"))
    counts = cut_lineage(triples_of(words, "language", "_c").groupBy("language", "triple").agg(F.sum("_c").alias("n")))
    features = counts.select("triple").distinct()
    number = features.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    # every language gets a value for every triple: one row of all counts per triple, then back to long form
    per_triple = counts.groupBy("triple").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("_n"))
    languages = totals.agg(F.collect_list(F.struct("language", "total")).alias("_langs")).scalar()
    long = per_triple.select("triple", "_n", F.explode(languages).alias("_l")).select(
        F.col("_l.language").alias("language"),
        "triple",
        F.coalesce(F.element_at("_n", F.col("_l.language")), F.lit(0)).alias("n"),
        F.col("_l.total").alias("total"),
    )
    logp = F.round(F.ln((F.col("n") + 1) / (F.col("total") + number)) * SCALE).cast("bigint")
    return long.select("language", "triple", logp.alias("logp"))


def identify_language(df: DataFrame, id: str, text: str, profile: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``id, language, score``: the language with the highest log probability, ties in alphabetical order.

    A text without any known triple gets no language. While the profile is small enough to be held by every executor, a text's triples
    are looked up and added up in the task that reads it, and one row of sums per text is all that moves. Beyond
    that size triples are counted per text first, and each different one of a text is moved once.
    """
    # one row per language, the columns of all sums
    languages = [r[0] for r in profile.select("language").distinct().orderBy("language").collect()]
    if not languages:
        return df.select(id, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("score"))
    values = F.transform(F.sort_array(F.collect_list(F.struct("language", "logp"))), lambda v: v["logp"])
    dense = cut_lineage(profile.groupBy("triple").agg(values.alias("v")))
    triples = triples_of(words_of(df, text, F.col(id).alias("_id")), "_id")
    if dense.count() * (8 * len(languages) + 32) <= held_bytes:
        met, times = triples.join(F.broadcast(dense), "triple"), F.lit(1).cast("bigint")
    else:
        met, times = triples.groupBy("_id", "triple").agg(F.count(F.lit(1)).alias("_c")).join(dense, "triple"), F.col("_c")
    sums = met.groupBy("_id").agg(*(F.sum(times * F.col("v")[k]).alias(f"_s{k}") for k in range(len(languages))))
    options = F.array(*(F.struct((-F.col(f"_s{k}")).alias("loss"), F.lit(language).alias("language")) for k, language in enumerate(languages)))
    best = sums.select("_id", F.array_min(options).alias("_best"))
    named = best.select(F.col("_id").alias(id), F.col("_best.language").alias("language"), (-F.col("_best.loss") / SCALE).alias("score"))
    return df.select(id).join(named, id, "left")
