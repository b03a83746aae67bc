"""What a topic model writes and shuffles: blocks of terms, vectors at most once per step, no texts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeter.operators import embedding, tokens
from pubmeter.plans import topics as plans
from pubmeter.session import cut_lineage, discard


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rows = [(i, i % 3 if i % 10 else None, f"alpha beta w{i % 7} Über w{i % 5} 我们发现 beta" if i % 11 else "") for i in range(200)]
    return spark.createDataFrame(rows, "id long, topic int, title string").repartition(5)


@pytest.mark.parametrize("gathered, at_once", [(1, 3), (32_000_000, 1_000)])
def test_blocks_hold_the_same_counts(spark, rows, monkeypatch, gathered, at_once):
    monkeypatch.setattr(tokens, "WORDS_GATHERED", gathered)
    monkeypatch.setattr(tokens, "TEXTS", at_once)
    names = ["topic", "term", "n", "df", "f", "place"]
    plain = tokens.term_uses(tokens.term_counts(texts(spark), "topic", "title", ["alpha"]), min_df=0, max_df=2)
    blocks = tokens.term_counts(texts(spark), "topic", "title", ["alpha"], uses=True)
    assert rows(blocks, *names) == rows(plain, *names)
    assert [(c, t) for c, t in blocks.dtypes] == plain.dtypes
    assert rows(tokens.vocabulary(blocks, max_df=1.0)) == rows(tokens.vocabulary(tokens.term_counts(texts(spark), "topic", "title", ["alpha"]), max_df=1.0))


def test_texts_without_words_have_no_blocks(spark):
    empty = spark.createDataFrame([(0, ""), (1, "a b")], "topic int, title string")
    assert tokens.term_counts(empty, "topic", "title", [], uses=True).count() == 0


def test_topics_of_text_and_pairs_that_do_not_cross_texts(spark):
    df = spark.createDataFrame([("x", "aa bb"), ("x", "cc aa"), ("y", "bb cc")], "topic string, title string")
    found = {(r.topic, r.term): (r.n, r.df, r.f) for r in tokens.term_counts(df, "topic", "title", [], uses=True).collect()}
    assert found == {("x", "aa"): (2, 1, 2), ("x", "bb"): (1, 2, 2), ("y", "bb"): (1, 2, 2), ("x", "cc"): (1, 2, 2), ("y", "cc"): (1, 2, 2), ("x", "aa bb"): (1, 1, 1), ("x", "cc aa"): (1, 1, 1), ("y", "bb cc"): (1, 1, 1)}


def test_blocks_are_shuffled_once_and_not_by_term(spark):
    found = plan(tokens.term_counts(texts(spark), "topic", "title", ["alpha"], uses=True))
    assert found.count("Exchange hashpartitioning(bucket") == 1 == found.count("Exchange hashpartitioning")
    assert "Window" not in found


@pytest.mark.parametrize("groups, size, tasks, dtype", [(40, 400, 8, "float"), (3, 600, 2, "double")])
def test_sums_of_components_do_not_outgrow_the_vectors(spark, monkeypatch, groups, size, tasks, dtype):
    m = np.random.default_rng(1).normal(size=(size, 16)).astype(np.float32) * np.arange(16, 0, -1, dtype=np.float32)
    df = spark.createDataFrame([(i, i % groups, x.tolist()) for i, x in enumerate(m)], f"id long, part int, vec array<{dtype}>").repartition(tasks)
    written = []
    monkeypatch.setattr(embedding, "cut_lineage", lambda d: written.append(cut_lineage(d)) or written[-1])
    found = {r.id: r.low for r in embedding.principal_components_by(df, "vec", 2, "part", "low").collect()}
    assert sum(w.count() for w in written) <= size
    for part in range(groups):
        own = m[part::groups].astype(float)
        own = own - own.mean(axis=0)
        axes = np.linalg.eigh(own.T @ own)[1][:, ::-1][:, :2]
        axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
        assert np.allclose([found[i] for i in range(part, size, groups)], own @ axes, atol=1e-6)


def test_pooled_means_are_the_means_of_all(spark):
    m = np.random.default_rng(2).normal(size=(30, 3))
    df = spark.createDataFrame([(i % 2, i % 3, x.tolist()) for i, x in enumerate(m)], "part int, topic int, vec array<double>").withColumn("half", F.rand(3) < 0.5)
    df = cut_lineage(df)
    pooled = tokens.pooled_centroids(tokens.topic_centroids(df.where("half"), by="part").unionByName(tokens.topic_centroids(df.where("NOT half"), by="part")), by="part")
    expected = {(r.part, r.topic): (r.vec, r.n) for r in tokens.topic_centroids(df, by="part").collect()}
    for r in pooled.collect():
        assert r.n == expected[r.part, r.topic][1] and np.allclose(r.vec, expected[r.part, r.topic][0])


def test_discarded_stages_are_gone(spark):
    one, other = cut_lineage(spark.range(5)), cut_lineage(spark.range(6))
    discard(one)
    assert not os.path.exists(one._stage.removeprefix("file:")) and other.count() == 6


def test_a_model_writes_no_texts_and_keeps_no_vectors(spark, monkeypatch):
    written = []
    monkeypatch.setattr(plans, "cut_lineage", lambda d: written.append(cut_lineage(d)) or written[-1])
    df = spark.createDataFrame([(i, f"word{i % 4} term{i % 4} other{i % 4}") for i in range(120)], "id long, title string")
    embedder = lambda d: embedding.hashed_embedding(d, "id", "title", weighted=False)
    model = plans.model_topics(df, 0.3, part_size=60, min_samples=3, min_cluster_size=5, embedder=embedder, stop=[], components=None)
    assert not any("title" in w.columns for w in written)
    assert not any(os.path.exists(w._stage.removeprefix("file:")) for w in written if {"id", "vec"} <= set(w.columns))
    assert model.documents.count() == 120 and model.info.agg(F.sum("count")).first()[0] == 120
    assert {r["count"] for r in model.info.collect()} == {30}
