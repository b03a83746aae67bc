from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeter.operators import clustering, embedding, language, merging, neighbours, tokens
from pubmeter.plans import topics as plans


def table(spark, vectors, ids=None):
    data = [(int(i), [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(data, "id long, vec array<double>")


def brute_neighbours(m, k, metric):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit @ unit.T if metric == "cosine" else np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    return {i: sorted(range(len(m)), key=lambda j: (d[i, j], j))[:k] for i in range(len(m))}, d


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_equals_brute_force(spark, metric):
    m = np.random.default_rng(5).normal(size=(150, 8))
    m[100:130] = m[100]  # a group of copies
    expected, _ = brute_neighbours(m, 4, metric)
    found = neighbours.nearest(table(spark, m), table(spark, m), 4, metric=metric, skip_same_id=True, block=40).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == expected


def test_nearest_within_groups(spark):
    df = table(spark, [[1, 0], [1, 0.1], [0, 1], [0.1, 1]]).withColumn("part", F.col("id") % 2)
    found = neighbours.nearest(df, df, 1, by="part", skip_same_id=True).collect()
    assert {(r["part"], r["id"], r["neighbour"]) for r in found} == {(0, 0, 2), (0, 2, 0), (1, 1, 3), (1, 3, 1)}


def components(n, linked):
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_forest_keeps_components(spark):
    m = np.random.default_rng(7).normal(size=(90, 2))
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    expected = components(90, d <= 0.25)
    edges = neighbours.similarity_forest(table(spark, m), 0.25, metric="euclidean", block=25)
    assert edges.count() < (d <= 0.25).sum() / 2
    found = {r["id"]: r["component"] for r in clustering.connected_components(edges).collect()}
    assert all(found.get(i, i) == expected[i] for i in range(90))


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(2).permutation(300)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])] + [(1000, 1001)], "a long, b long")
    found = {r["id"]: r["component"] for r in clustering.connected_components(edges).collect()}
    assert {found[int(i)] for i in order} == {0} and found[1001] == 1000


def test_density_clusters_of_planted_groups(spark):
    rng = np.random.default_rng(11)
    centres = [(0, 0), (5, 5), (10, 0)]
    points = np.concatenate([c + rng.normal(scale=0.1, size=(n, 2)) for c, n in zip(centres, (30, 20, 10))] + [[[50, 50]], [[-40, 9]]])
    out = clustering.density_cluster(table(spark, points), 0.5, min_samples=3, min_cluster_size=5, metric="euclidean", block=16)
    topics = [r["topic"] for r in out.orderBy("id").collect()]
    assert topics == [0] * 30 + [1] * 20 + [2] * 10 + [-1, -1]
    small = clustering.density_cluster(table(spark, points), 0.5, min_samples=3, min_cluster_size=15, metric="euclidean", block=16)
    assert [r["topic"] for r in small.orderBy("id").collect()] == [0] * 30 + [1] * 20 + [-1] * 12


def at_cosine(c):
    return [c, math.sqrt(1 - c * c)]


def test_outliers_move_above_the_threshold(spark, rows):
    docs = table(spark, [[1, 0, 0], [*at_cosine(0.09), 0], [*at_cosine(0.11), 0]]).withColumn("topic", F.when(F.col("id") == 0, 4).otherwise(-1))
    centroids = tokens.topic_centroids(docs.where("topic <> -1"))
    assert rows(tokens.reduce_outliers(docs, centroids)) == [(0, 4), (1, -1), (2, 4)]
    titled = docs.withColumn("id", F.concat(F.lit("Title "), F.col("id").cast("string")))
    assert rows(tokens.reduce_outliers(titled, centroids)) == [("Title 0", 4), ("Title 1", -1), ("Title 2", 4)]


def test_topics_merge_above_the_threshold(spark, rows):
    data = [(1, 0, [1.0, 0.0]), (1, -1, [1.0, 0.0]), (2, 0, at_cosine(0.69)), (2, 1, at_cosine(0.71)), (3, 0, at_cosine(0.69))]
    centroids = spark.createDataFrame(data, "part int, topic int, vec array<double>")
    mapping, merged = merging.merge_topics(centroids)
    assert rows(mapping) == [(1, 0, 0), (2, 0, 1), (2, 1, 0), (3, 0, 1)]
    assert rows(merged, "merged") == [(0,), (1,)]
    docs = spark.createDataFrame([(1, 2, 0), (2, 2, 1), (3, 2, -1)], "id int, part int, topic int")
    assert rows(merging.remap_documents(docs, mapping), "id", "topic") == [(1, 1), (2, 0), (3, -1)]


def test_terms(spark):
    df = spark.createDataFrame([("Análise de dados x DADOS abertos",)], "t string")
    listed = tokens.terms(df, "t", stop=["de"]).first()["terms"]
    assert listed == ["análise", "dados", "dados", "abertos", "análise dados", "dados dados", "dados abertos"]
    words = tokens.stop_words()
    assert {"the", "der", "journal", "artigo"} <= set(words) and len(words) > 2000


def test_class_tfidf_by_hand(spark):
    texts = [(0, "cat cat dog"), (1, "dog fish")]
    df = spark.createDataFrame(texts, "topic int, text string")
    counts = tokens.term_counts(df, "topic", "text", []).where(~F.col("term").contains(" "))
    weights = {(r["topic"], r["term"]): r["weight"] for r in tokens.class_tfidf(counts, max_df=1.0).collect()}
    a = 2  # whole part of (3 + 2) / 2
    assert weights[(0, "cat")] == pytest.approx(2 / 3 * math.log(1 + a / 2))
    assert weights[(0, "dog")] == pytest.approx(1 / 3 * math.log(1 + a / 2))
    assert weights[(1, "fish")] == pytest.approx(1 / 2 * math.log(1 + a / 1))
    assert (0, "dog") not in {(r["topic"], r["term"]) for r in tokens.class_tfidf(counts, max_df=0.8).collect()}


def test_labels(spark, rows):
    info = spark.createDataFrame([(0, ["a", "b", "c", "d"]), (1, None)], "topic int, representation array<string>")
    assert rows(tokens.topic_labels(info), "label") == [("0 - a b c",), ("1 - NA",)]
    better = spark.createDataFrame([(1, "1 - One")], "topic int, label string")
    assert rows(tokens.topic_labels(info, better), "label") == [("0 - a b c",), ("1 - One",)]


def test_language(spark):
    data = [("en", "the house and the garden with the trees"), ("pt", "a casa e o jardim com as árvores não"), (None, "das Haus")]
    labelled = spark.createDataFrame(data, "lang string, text string")
    profile = language.language_profile(labelled, "text", "lang")
    texts = spark.createDataFrame([(1, "the tree and the house"), (2, "o jardim não"), (3, "123"), (4, None)], "id int, text string")
    found = {r["id"]: (r["language"], r["score"]) for r in language.identify_language(texts, "id", "text", profile).collect()}
    assert found[1][0] == "en" and found[2][0] == "pt" and found[1][1] < 0
    assert found[3] == (None, None) and found[4] == (None, None)


def test_principal_components(spark):
    m = np.random.default_rng(4).normal(size=(60, 6)) * [5, 3, 1, 1, 1, 1] + 10
    centred = m - m.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    v *= np.sign(v[np.arange(6), np.abs(v).argmax(axis=1)])[:, None]
    expected = centred @ v[:2].T
    scores = embedding.principal_components(table(spark, m), "vec", 2).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in scores], expected, atol=1e-8)


def test_hashed_embedding_has_unit_length(spark):
    df = spark.createDataFrame([(1, "water quality in rivers"), (2, "river water"), (3, "")], "id int, t string")
    lengths = {r["id"]: float(np.linalg.norm(r["vec"])) for r in embedding.hashed_embedding(df, "id", "t", weighted=False).collect()}
    assert lengths[1] == pytest.approx(1, abs=1e-6) and lengths[3] == 0


def test_model_finds_groups_of_like_titles(spark):
    words = ["soil nitrogen corn yield", "school teacher training policy", "protein folding membrane energy"]
    data = [(i, f"{words[i % 3]} {words[i % 3]} case {i}") for i in range(90)]
    texts = spark.createDataFrame(data, "id long, title string")
    model = plans.model_topics(texts, 0.45, part_size=45, min_samples=3, min_cluster_size=5, embedder=lambda d: embedding.hashed_embedding(d, "id", "title", weighted=False))
    by_topic = {}
    for r in model.documents.collect():
        by_topic.setdefault(r["topic"], set()).add(r["id"] % 3)
    assert len(by_topic) == 3 and all(len(groups) == 1 for groups in by_topic.values())
    labels = {r["label"] for r in model.info.collect()}
    assert len(labels) == 3 and model.centroids.count() == 3
