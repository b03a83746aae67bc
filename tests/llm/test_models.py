from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeter.llm import language, mixing, quality, toxicity
from pubmeter.llm.labelled import remainder
from pubmeter.llm.registered import domains, table


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def toxic_model(spark, larger):
    return toxicity.fit(table(spark, larger, "documents"), table(spark, larger, "labels"))


def test_toxicity_on_rows_it_has_not_learned_from(spark, larger, toxic_model):
    docs = table(spark, larger, "documents").withColumn("held", remainder() == 2).where("held")
    rows = toxicity.score_toxicity(docs, toxic_model).join(table(spark, larger, "labels"), "doc_id").collect()
    assert all(r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    yes = [r for r in rows if r["toxic"] == 1]
    no = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in yes]) > 0.7
    assert np.mean([r["predicted"] for r in no]) < 0.03
    assert np.mean([(r["score"] - r["toxic"]) ** 2 for r in rows]) < 0.5 * len(yes) / len(rows)


def test_toxicity_of_odd_rows(odd, none, toxic_model):
    found = toxicity.score_toxicity(odd, toxic_model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in odd.collect())
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1)}) == 1
    kept = toxicity.drop_toxic(odd, toxic_model)
    assert kept.schema == odd.schema
    assert kept.count() == sum(r["predicted"] == 0 for r in found)
    assert toxicity.drop_toxic(none, toxic_model).count() == 0


def test_toxicity_without_labels(odd, none):
    labels = odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    model = toxicity.fit(odd, labels)
    assert {r["score"] for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.fit(none, labels.where("false")).trees == []
    one = toxicity.fit(odd, odd.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, one).collect()} == {1}


def test_toxicity_ignores_labels_of_held_out_rows(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    turned = labels.withColumn("toxic", F.when(remainder() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.lexicon == b.lexicon and a.base == b.base


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, larger, odd, none):
    docs = table(spark, larger, "documents")
    model = quality.fit(docs.where("doc_id % 2 = 0"), table(spark, larger, "labels"))
    held = quality.judge(docs.where("doc_id % 2 = 1"), model).join(table(spark, larger, "labels").withColumnRenamed("quality", "good"), "doc_id").where("NOT base_failed").collect()
    good = np.array([r["good"] == 1 for r in held])
    assert len(held) > 100
    kept = np.array([r["kept"] for r in held])
    assert (kept == good).mean() > 0.95
    assert kept[good].mean() > 0.97
    rows = docs.limit(300).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = quality.judge(rows, model).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in found) == Counter((r["doc_id"], *slow_base(r["text"] or "")) for r in rows.collect())
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert quality.judge(none, model).count() == 0


def test_quality_is_alike_in_blocks_and_alone(monkeypatch):
    data = [f"text {k} with words {k * k}".encode() * (1 + k % 5) for k in range(50)] + [b"", b" "]
    weights = np.random.default_rng(3).normal(size=quality.FAMILIES * quality.BUCKETS)
    together = quality.logits(data, weights, 0.5)
    assert np.allclose(together, [quality.logits([x], weights, 0.5)[0] for x in data])
    assert np.allclose(together, [quality.vector(x).dot(weights) + 0.5 for x in data])


@pytest.mark.parametrize("block", [5, 37, 64, 1000])
def test_quality_does_not_depend_on_the_block(monkeypatch, block):
    rng = np.random.default_rng(4)
    data = [bytes(rng.choice(list(b"abcABC \n\t"), n)) for n in (3, 36, 37, 38, 100, 700)] + [b"x" * 300, b" " * 90, b"a " * 60, b" " * 37 + b"end", b"word" * 9 + b" " + b"next" * 20]
    weights = rng.normal(size=quality.FAMILIES * quality.BUCKETS)
    whole, vectors = quality.logits(data, weights, 0.5), [quality.vector(x) for x in data]
    monkeypatch.setattr(quality, "BLOCK", block)
    assert np.allclose(quality.logits(data, weights, 0.5), whole)
    assert all(np.allclose(quality.vector(x).toArray(), v.toArray()) for x, v in zip(data, vectors))


def test_quality_without_labels(odd):
    model = quality.fit(odd, odd.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert all(r["kept"] is not r["base_failed"] for r in quality.judge(odd, model).collect())


def test_languages(spark, larger):
    docs = table(spark, larger, "documents").where("lang IS NOT NULL")
    model = language.fit(docs.where("doc_id % 3 = 0"))
    rows = docs.where("doc_id % 3 = 1").limit(600).collect()
    assert np.mean([model.languages[int(np.argmax(model.log_likelihoods(r["text"])))] == r["lang"] for r in rows]) > 0.98
    page = lambda lang, text: f"<html{lang}><head><script>var x = 'the and of';</script></head><body><p>{text}</p></body></html>"
    text = {y: next(r["text"] for r in rows if r["lang"] == y)[:300] for y in model.languages}
    pages = [(k, f"http://h{y}.example.{y}/{k}", page(f' lang="{y}"', text[y])) for y in text for k in range(5)]
    # no words at all: markup and host speak
    pages += [(100, "http://hde.example.de/x", page("", "")), (101, "http://new.example.fr/x", page("", "")), (102, "no address", page(' lang="es"', "")), (103, None, None), (None, "http://hde.example.de/y", page("", ""))]
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)), model).collect()
    assert len(found) == len(pages)
    got = {r["page_id"]: r["language"] for r in found}
    assert (got[100], got[101], got[102], got[None]) == ("de", "fr", "es", "de")
    assert all(0 <= r["probability"] <= 1 for r in found)
    by_host = {r["host"]: r["language"] for r in found if r["page_id"] is not None and r["page_id"] < 100}
    assert by_host == {f"h{y}.example.{y}": y for y in text}
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    unknown = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), language.fit(docs.where("false"))).collect()
    assert {r["language"] for r in unknown} == {None} and len(unknown) == len(pages)


def slow_rates(tokens, q, goals, steps):
    start = tokens @ q
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.maximum(r - q @ (((r * tokens) @ q - goals) / start), 0)
    return r


def test_mixture(spark, larger):
    docs = table(spark, larger, "documents")
    for targets in ({"high": 0.92, "low": 0.08}, {"high": 0.5, "low": 0.5}, {"low": 0.9, "high": 0.1}):
        model = mixing.fit(docs, domains(spark, larger), targets)
        rows = mixing.rates(docs, model).collect()
        q, tokens = np.array([r["posterior"] for r in rows]), np.array([r["tokens"] for r in rows], float)
        rate = np.array([r["rate"] for r in rows])
        assert (rate >= 0).all()
        assert np.allclose(q.sum(axis=1), 1)
        totals = (rate * tokens) @ q
        assert np.allclose(totals / totals.sum(), [targets[d] for d in model.domains], atol=2e-3)
        weights = np.array([targets[d] for d in model.domains])
        goals = min((tokens @ q) / weights) * weights
        assert np.allclose(rate, slow_rates(tokens, q, goals, len(model.residuals)), atol=1e-6)
        assert abs(np.mean([r["copies"] for r in rows]) - rate.mean()) < 0.03
    truth = {r["doc_id"]: r["domain"] for r in domains(spark, larger).collect()}
    right = [(model.domains[int(np.argmax(r["posterior"]))] == truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert np.mean(right) > 0.9


def test_mixture_of_odd_rows(spark, odd, none, larger):
    model = mixing.fit(table(spark, larger, "documents"), domains(spark, larger), mixing.TARGETS, most=1.0)
    rows = mixing.rates(odd, model).collect()
    assert len(rows) == odd.count()
    drawn = mixing.draw(odd, model)
    assert drawn.columns == odd.columns
    assert Counter(r["n"] for r in drawn.collect()) <= Counter(r["n"] for r in odd.collect())
    assert all(0 <= r["rate"] <= 1 for r in rows)
    free = mixing.fit(none, domains(spark, larger), mixing.TARGETS)
    assert {r["rate"] for r in mixing.rates(odd, free).collect()} == {1.0}
    assert mixing.draw(none, model).count() == 0
