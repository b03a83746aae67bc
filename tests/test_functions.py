from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pubmeter.functions import nulls as N
from pubmeter.functions import text as X


def one(spark, column, **values):
    literals = [F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*literals).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (X.punctuation_to_space, "a“b”—c$d+e¿f", "a b  c d e f"),
        (lambda c: X.squish(X.punctuation_to_space(c)), "a“b”—c$d+e¿f", "a b c d e f"),
        (X.squish, "a b", "a b"),
        (X.squish, "  a \t\n b  ", "a b"),
        (X.drop_words, "Authorship", "ship"),
        (X.drop_words, "AutReplyhor", "Author"),
        (X.normalise_doi, " doi:DOI:10.1/x ", "10.1/x"),
        (X.normalise_doi, "DOI: 10.1/x", "10.1/x"),
        (X.strip_quotes, "'10.1/\"a\"'", "10.1/a"),
        (X.doi_key, '"DOI:10.1/A"', "10.1/a"),
        (X.doi_key, '""', None),
        (X.strip_double_quotes, '"a"', "a"),
        (X.safe_int, "20x8", None),
        (X.safe_int, " 2008 ", 2008),
        (X.safe_int, "2008.5", None),
        (X.first_word, "Ana Maria", "Ana"),
        (X.words_after_first, "Ana", None),
        (X.words_after_first, "Ana Maria Silva", "Maria Silva"),
        (X.after_last_dash, "12 - A - B", "B"),
        (X.after_last_dash, "plain", "plain"),
        (X.tokens, "Análise de dados x", ["análise", "de", "dados"]),
    ],
)
def test_text(spark, function, value, expected):
    assert one(spark, function(F.col("v")), v=value) == expected


def test_rounding(spark):
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(X.round_half_even(F.col("x")).alias("r"))
    assert sorted(r[0] for r in halves.collect()) == [0.0, 2.0, 2.0]
    shares = spark.createDataFrame([(0.94,), (0.4567,)], "x double").select(X.percent_text(F.col("x")).alias("t"))
    assert sorted(r[0] for r in shares.collect()) == ["45.7%", "94%"]


@pytest.mark.parametrize(
    ("name", "as_published", "expected"),
    [
        ("Ed Carlos Silva", False, ("Carlos", "Silva")),
        ("Ed Carlos Silva", True, ("Carlos", "Carlos Silva")),
        ("Ana", False, ("Ana", None)),
        ("Maria Silva", False, ("Maria", "Silva")),
    ],
)
def test_names(spark, name, as_published, expected):
    first, last = X.split_name(F.lit(name), as_published=as_published)
    assert tuple(spark.range(1).select(first, last).first()) == expected


def test_missing_values(spark):
    df = spark.createDataFrame([("en",), ("pt",), (None,)], "c string")
    values = lambda c: {r[0]: r[1] for r in df.select("c", c).collect()}
    assert values(N.if_else(F.col("c") == "en", "English", "Other")) == {"en": "English", "pt": "Other", None: None}
    assert values(N.not_in(F.col("c"), ["en"])) == {"en": False, "pt": True, None: True}
    assert values(N.in_list(F.col("c"), ["en"])) == {"en": True, "pt": False, None: False}
    assert values(N.is_filled(F.col("c")))["en"] is True
    assert values(N.with_missing(F.col("c")))[None] == "NA"


def test_short_identifiers_become_missing(spark):
    df = spark.createDataFrame([("123456",), ("1234567",), ("",)], "c string")
    kept = [r[0] for r in df.select(N.null_if_shorter(F.col("c"), 7)).collect()]
    assert kept == [None, "1234567", None]


def test_title_length_limit(spark, rows):
    from pubmeter.plans.metadata import clean_titles

    df = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",), ("Author: abcdefghijk",), (None,)], "title string")
    assert rows(clean_titles(df), "title") == [("abcdefghijk",), ("abcdefghijk",)]
