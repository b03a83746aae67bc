"""Texts that once took hours: each is read in one pass."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pubmeter.llm import language, toxicity

OLD = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
OLD_DECLARED = re.compile(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})")


@pytest.mark.parametrize("piece", ["<!-- ", "<script ", "<style>", "<", "</script ", "<html ", "lang =", "&amp", "a<b "])
def test_pages_are_read_in_one_pass(piece):
    html = piece * (5_000_000 // len(piece))
    start = time.time()
    language.page_text(html)
    language.declared_language(html)
    assert time.time() - start < 10


@pytest.mark.parametrize("piece", ["a", "a1", "1", "a.", "Ab-", "$", "a*****"])
def test_words_are_read_in_one_pass(piece):
    start = time.time()
    found = toxicity.features(piece * (5_000_000 // len(piece)), toxicity.Weights({"aaa": 3.0}))
    assert time.time() - start < 10 and np.isfinite(found).all()


@given(st.lists(st.sampled_from(["<!--", "-->", "<script", "</script >", "<STYLE>", "</style>", "<p a='>'>", ">", "<", "x", " ", "\n", "&lt;", "<html lang=de", "lang=en"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_pages_read_as_before(pieces):
    html = "".join(pieces)
    # an unclosed script or comment is a tag where it has an end, as it was by the pattern
    assert language.page_text(html) == language.entities.unescape(OLD.sub(" ", html))
    found = OLD_DECLARED.search(html)
    assert language.declared_language(html) == (found and found[1].lower())


def test_every_labelled_language_is_learned(spark):
    rows = [("en", f"the house and garden number {i} with trees") for i in range(2_000)] + [("xx", f"qua zor vex mip {i % 3}") for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ("en", "xx")
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>zor vex qua mip zor vex"), (2, None, "the garden and the trees")], "page_id int, url string, html string")
    assert {r["page_id"]: r["text_language"] for r in language.identify(pages, model).collect()} == {1: "xx", 2: "en"}


def test_margin_is_the_models_own(spark):
    """Trees as arrays give the fitted model's raw prediction."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, toxicity.FEATURES))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "label double, x array<double>").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=7).fit(df)
    raw = [r["m"] for r in model.transform(df).select((vector_to_array("rawPrediction")[1]).alias("m")).collect()]
    assert np.allclose(toxicity.margin(toxicity._arrays(model), x) * 2, np.array(raw) * 2)


def test_calibration_is_drawn_towards_the_base(spark):
    judged = spark.createDataFrame([(1.0, 0.9), *[(0.0, k / 100) for k in range(50)]], "label double, score double")
    at, value = toxicity.shrunk((np.array([0.0, 0.49, 0.9, 0.95]), np.array([0.0, 0.0, 1.0, 1.0])), judged, 0.1)
    assert value[0] == pytest.approx(0.1 * 2 / 52) and value[2] == pytest.approx((1 + 0.2) / 3) and (np.diff(value) >= 0).all()


def test_small_label_tables(spark):
    """Held-out rows of a table with few labels: most toxic ones are caught and few clean ones rejected."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).where("held_out").join(labels.select("doc_id", F.col("toxic")), "doc_id").where("toxic IS NOT NULL").collect()
    yes, no = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(yes) / len(yes) > 8 / 14 and sum(no) / len(no) < 15 / 80
