from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeter.operators import buckets, clustering, embedding, language, merging, neighbours, ordering, skew, statistics
from pubmeter.plans import coverage, matching, reports
from pubmeter.plans import topics as plans
from tests.test_topics import brute_neighbours, table


# --- joins and order ----------------------------------------------------------------------------------


def test_salts_follow_the_weight_of_a_key(spark):
    """One key with 30 percent and one with 0.9 percent of the rows: no task has much more than its share."""
    data = spark.range(100_000).select("id", F.when(F.col("id") % 10 < 3, -1).when(F.col("id") % 1000 >= 991, -2).otherwise(F.col("id")).alias("k"))
    found = spark.range(1).select(skew.hot_salts(data, ["k"], 64).alias("h"), F.xxhash64(F.lit(-1).cast("long")).alias("a"), F.xxhash64(F.lit(-2).cast("long")).alias("b")).first()
    salts = dict(zip(found["h"]["hashes"], found["h"]["salts"]))
    assert set(salts) == {found["a"], found["b"]} and 70 <= salts[found["a"]] <= 80 and 2 <= salts[found["b"]] <= 4
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = skew.skew_join(data, data.select("k").distinct().withColumn("v", F.lit(1)), "k", "inner", profile=data)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 100_000 and max(sizes) < 2.5 * 100_000 / 64


def test_running_total_and_ranks_by_group(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    rng = np.random.default_rng(0)
    rows = [(g, int(v)) for g, n in (("a", 150), ("b", 9), (None, 30)) for v in rng.permutation(1000)[:n]]
    df = spark.createDataFrame(rows, "g string, v int")
    found = {(r["g"], r["v"]): r["t"] for r in ordering.running_total(df, "v", F.col("v"), "t", "g").collect()}
    assert found == {(g, v): sum(w for h, w in rows if h == g and w < v) for g, v in rows}
    tied = spark.createDataFrame([(g, v % 7) for g, v in rows], "g string, v int")
    ranks = {(r["g"], r["v"]): r["rank"] for r in ordering.average_rank(tied, "v", by="g").collect()}
    for g in ("a", "b", None):
        values = [v % 7 for h, v in rows if h == g]
        assert all(ranks[(g, v)] == sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values)


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=333), "b": np.repeat(rng.normal(size=5), 9), "c": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("d", None), ("a", None)], "g string, v double")
    p = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    found = {r["g"]: (r["n"], r["quantiles"]) for r in ordering.quantiles(df, "v", p, "g").collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g][0] == len(values) and np.allclose(found[g][1], np.quantile(values, p))
    assert np.allclose(ordering.quantiles(df.where("g = 'a'"), "v", [0.5]).first()["quantiles"], np.quantile(groups["a"], [0.5]))
    assert ordering.quantiles(df.where("g = 'd'"), "v", [0.5]).count() == 0


# --- statistics ---------------------------------------------------------------------------------------


def test_rank_sum_test(spark):
    # the published example of nine untied pairs: rank sum 48, correlation 0.6, significance 0.0968
    x = [44.4, 45.9, 41.9, 53.3, 44.7, 44.1, 50.7, 45.2, 60.1]
    y = [2.6, 3.1, 2.5, 5.0, 3.6, 4.0, 5.2, 2.8, 3.8]
    row = statistics.spearman(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    assert (row["n"], row["s"], row["r"]) == (9, pytest.approx(48), pytest.approx(0.6)) and row["p_value"] == pytest.approx(0.0968, abs=5e-5)
    sums = [sum((a - b) ** 2 for a, b in enumerate(q)) for q in itertools.permutations(range(6))]
    assert statistics.rank_sum_counts(6) == {s: sums.count(s) for s in set(sums)}
    for s in (0, 10, 30, 36, 60, 70):
        upper, lower = sum(t >= s for t in sums) / 720, sum(t <= s for t in sums) / 720
        assert statistics.rank_sum_p(s, 6) == pytest.approx(min(1, 2 * (upper if s > 35 else lower)))
    counts = statistics.rank_sum_counts(10)
    total = math.factorial(10)
    for s in range(20, 300, 40):
        assert statistics.rank_sum_tail(s, 10, False) == pytest.approx(sum(c for t, c in counts.items() if t >= s) / total, abs=2e-3)
    assert statistics.rank_sum_p(5, 1) is None


def test_correlations_of_many_measures_in_few_jobs(spark):
    rng = np.random.default_rng(2)
    rows = [(*map(float, np.round(rng.normal(size=4), 1)), None if i % 17 == 0 else float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    group = "correlations"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = {r["ind"]: r for r in reports.topic_correlations(df, ["a", "b", "c", "e"], "d").collect()}
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k, m in enumerate("abce"):
        known = [(r["abcde".index(m)], r[3]) for r in rows if r["abcde".index(m)] is not None]
        ranks = [[sum(w < v for w in c) + (c.count(v) + 1) / 2 for v in c] for c in map(list, zip(*known))]
        assert found[m]["n"] == len(known) and found[m]["r"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
        assert found[m]["p_value"] == pytest.approx(statistics.student_p(found[m]["t"], len(known) - 2))
    assert jobs <= 25  # stages of shuffles count as jobs here; their number does not follow that of the measures


@pytest.mark.parametrize("bins", [101, 401])
def test_density_grid_error(spark, bins):
    rng = np.random.default_rng(3)
    points = {"a": rng.normal(size=(400, 2)), "b": rng.normal(size=(50, 2)) * [0.5, 2] + 1}
    df = spark.createDataFrame([(g, float(x), float(y)) for g, p in points.items() for x, y in p] + [("a", None, 1.0)], "g string, x double, y double")
    h = (0.4, 0.6)
    every = np.concatenate(list(points.values()))
    low, high = every.min(0), every.max(0)
    bound = sum(((b - a) / (bins - 1) / w) ** 2 for a, b, w in zip(low, high, h)) / 8 / (2 * math.pi * h[0] * h[1])
    found = statistics.density_grid(df, "g", "x", "y", 20, h, bins).collect()
    assert len(found) == 800
    for r in found:
        p = points[r["g"]]
        exact = np.exp(-(((r["x"] - p[:, 0]) / h[0]) ** 2 + ((r["y"] - p[:, 1]) / h[1]) ** 2) / 2).mean() / (2 * math.pi * h[0] * h[1])
        assert abs(r["density"] - exact) <= bound + 1e-12


def test_reference_bandwidth(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(200, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in p] + [("flat", 1.0, float(y)) for _, y in p], "_g string, _x double, _y double")
    found = {r["_g"]: r for r in statistics.reference_bandwidths(df).collect()}
    for k, name in enumerate(("hx", "hy")):
        q = np.quantile(p[:, k], [0.25, 0.75])
        assert found["a"][name] == pytest.approx(1.06 * min(p[:, k].std(ddof=1), (q[1] - q[0]) / 1.34) * 200**-0.2)
    assert found["flat"]["hx"] == 0
    named = df.withColumnsRenamed({"_g": "g", "_x": "x", "_y": "y"})
    assert {r["g"] for r in statistics.density_grid(named, "g", "x", "y", 5).collect()} == {"a"}


# --- vectors ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def supplied(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 2).alias("part"))


def test_recall_of_buckets(spark, supplied):
    """Buckets of at most a quarter of the rows find the true neighbours, with exact distances and a fixed number of copies."""
    exact = {(r["id"], r["neighbour"]): r["distance"] for r in neighbours.nearest(supplied, supplied, 10, skip_same_id=True).collect()}
    found = {(r["id"], r["neighbour"]): r["distance"] for r in buckets.nearest_in_buckets(supplied, supplied, 10, skip_same_id=True, limit=125).collect()}
    assert len(set(exact) & set(found)) >= 0.95 * len(exact)
    assert all(found[k] == exact[k] for k in set(exact) & set(found))
    signed = buckets.signatures(supplied, "id", "vec")
    assert signed.count() == buckets.TABLES * supplied.count()
    sizes = buckets.leaves(signed, buckets.default_depths(500, 125), 125)
    assert sizes.agg(F.max("rows")).first()[0] <= 125 and sizes.groupBy("table").agg(F.sum("rows").alias("n")).where("n <> 500").isEmpty()


def test_buckets_by_group_and_with_copies(spark):
    m = np.random.default_rng(6).normal(size=(120, 8))
    m[40:100] = m[40]  # copies that no hyperplane tells apart
    df = table(spark, m).withColumn("part", F.col("id") % 2)
    found = buckets.nearest_in_buckets(df, df, 3, by="part", skip_same_id=True, limit=10, tables=20)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        assert r["id"] % 2 == r["neighbour"] % 2 == r["part"]
        got.setdefault(r["id"], []).append(r["neighbour"])
    even, _ = brute_neighbours(m[::2], 3, "cosine")
    assert all(got[2 * i] == [2 * j for j in even[i]] for i in range(20, 50))
    empty = df.where("id > 1000")
    assert buckets.nearest_in_buckets(empty, empty, 3).count() == 0
    others = table(spark, m[:5], range(500, 505))
    crossed = buckets.nearest_in_buckets(others, df, 1, limit=200).collect()
    assert {r["id"]: r["neighbour"] for r in crossed} == {500 + i: i for i in range(5)}


def test_minimum_forest(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b), float(rng.integers(1, 9))) for a, b in rng.integers(0, 60, (140, 2))]
    found = clustering.minimum_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    label = list(range(60))
    wanted = []
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if label[a] != label[b]:
            wanted.append((a, b, w))
            label = [label[a] if x == label[b] else x for x in label]
    assert sorted(tuple(r) for r in found) == sorted(wanted)


def test_leaves_of_different_densities(spark):
    rng = np.random.default_rng(11)
    tight = [np.array(c) + rng.normal(scale=0.05, size=(n, 2)) for c, n in (((0, 0), 40), ((1.2, 0), 30))]
    loose = np.array([30, 0]) + rng.normal(scale=2.0, size=(60, 2))
    points = np.concatenate([*tight, loose, [[300, 300]]])
    df = table(spark, points)
    settings = {"min_samples": 4, "min_cluster_size": 15, "metric": "euclidean"}
    levels = {"levels": 25}
    # one distance either joins the two tight groups or dissolves the loose one
    for eps in (0.3,):
        one = [r["topic"] for r in clustering.density_cluster(df, eps, **settings).orderBy("id").collect()]
        groups = [set(one[:40]), set(one[40:70]), set(one[70:130])]
        assert groups[0] & groups[1] - {-1} or one[70:130].count(-1) > 20
    found = [r["topic"] for r in clustering.density_leaves(df, **settings, **levels).orderBy("id").collect()]
    label = [max(set(part) - {-1}, key=part.count) for part in (found[:40], found[40:70], found[70:130])]
    assert len(set(label)) == 3 and found[130] == -1
    assert found[:40].count(label[0]) >= 36 and found[40:70].count(label[1]) >= 26 and found[70:130].count(label[2]) >= 40
    # a floor for splits above the gap makes the tight groups one
    joined = [r["topic"] for r in clustering.density_leaves(df, epsilon=1.5, **settings, **levels).orderBy("id").collect()]
    assert len(set(joined[:70])) == 1 and joined[0] != -1


def test_leaves_within_groups(spark):
    rng = np.random.default_rng(12)
    points = np.concatenate([np.array(c) + rng.normal(scale=0.1, size=(20, 2)) for c in ((0, 0), (9, 9), (0, 0), (9, 9))])
    df = table(spark, points).withColumn("part", F.when(F.col("id") < 40, "a").otherwise("b"))
    found = clustering.density_leaves(df, by="part", min_samples=3, min_cluster_size=8, metric="euclidean", levels=15, find=buckets.nearest_in_buckets).orderBy("id").collect()
    for part in ("a", "b"):
        topics = [r["topic"] for r in found if r["part"] == part]
        assert {0, 1} <= set(topics) <= {-1, 0, 1} and not set(topics[:20]) & set(topics[20:]) - {-1}


def test_components_of_each_part(spark):
    rng = np.random.default_rng(13)
    parts = {1: rng.normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1] + 10, 2: rng.normal(size=(70, 6)) * [1, 1, 1, 2, 4, 1] - 3}
    rows = [(p, i, [float(x) for x in v]) for p, m in parts.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "part int, id int, vec array<double>").repartition(5)
    found = embedding.principal_components_by(df, "vec", 2, "part").orderBy("part", "id").collect()
    for p, m in parts.items():
        centred = m - m.mean(0)
        _, _, v = np.linalg.svd(centred, full_matrices=False)
        v *= np.sign(v[np.arange(6), np.abs(v).argmax(axis=1)])[:, None]
        assert np.allclose([r["vec"] for r in found if r["part"] == p], centred @ v[:2].T, atol=1e-8)
        alone = embedding.principal_components(df.where(F.col("part") == p), "vec", 2).orderBy("id").collect()
        assert np.allclose([r["vec"] for r in found if r["part"] == p], [r["vec"] for r in alone], atol=1e-8)
    assert embedding.principal_components_by(df.withColumn("vec", F.when(F.col("id") > 0, F.col("vec"))), "vec", 2, "part").where("vec IS NULL").count() == 2


def test_merge_equals_the_fold(spark):
    rng = np.random.default_rng(14)
    data = [(p, t, [float(x) for x in rng.normal(size=3)]) for p in (3, 5, 6, 9, 12) for t in range(-1, 12)]
    mapping, merged = merging.merge_topics(spark.createDataFrame(data, "part int, topic int, vec array<double>"), 0.8)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    known, wanted = [], {}
    for p in (3, 5, 6, 9, 12):
        fresh = []
        for part, t, v in data:
            if part == p and t != -1:
                near = min(((round(1 - float(unit(v) @ unit(w)), 9), m) for m, w in known), default=(9, None)) if p != 3 else (9, None)
                if 1 - near[0] >= 0.8:
                    wanted[(p, t)] = near[1]
                else:
                    number = t if p == 3 else max(m for m, _ in known) + 1 + len(fresh)
                    wanted[(p, t)] = number
                    fresh.append((number, v))
        known += fresh
    assert {(r["part"], r["topic"]): r["merged"] for r in mapping.collect()} == wanted
    assert {r["merged"] for r in merged.collect()} == {m for m, _ in known}
    assert len(set(wanted.values())) < len(wanted)


def test_language_of_large_profiles(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profile = language.language_profile(texts, "text", "lang")
    held, shuffled = (language.identify_language(texts, "doc_id", "text", profile, held_bytes=n) for n in (1 << 30, 0))
    assert sorted(map(tuple, held.collect()), key=str) == sorted(map(tuple, shuffled.collect()), key=str)
    none = language.identify_language(texts, "doc_id", "text", profile.limit(0))
    assert none.where("language IS NULL AND score IS NULL").count() == texts.count()


# --- index B and topics -------------------------------------------------------------------------------


def test_index_b_by_the_key_of_identifiers(spark, rows):
    """Identifiers with prefix, quotes or other case are found; as spelled they are not."""
    meta = spark.createDataFrame([(1, "doi:10.1/a"), (2, "DOI: 10.1/b "), (3, "10.1/c"), (4, None), (5, ""), (6, "10.1/C")], "id int, doi string")
    identifiers = spark.createDataFrame([(11, "10.1/a", "doi"), (12, "10.1/b", "pmid"), (13, "10.1/c", "doi"), (14, "", "doi")], "article_id int, identifier string, type string")
    articles = spark.createDataFrame([(11, 1), (12, 1), (13, None)], "article_id int, discipline_code int")
    disciplines = spark.createDataFrame([(1, "s", "d")], "discipline_code int, specialty string, discipline string")
    matches = matching.listed_matches(meta, identifiers, articles, disciplines)
    assert rows(matches, "doi", "article_id") == [("10.1/a", 11), ("10.1/b", 12), ("10.1/c", 13)]
    doc_topic = spark.createDataFrame([(i, 0) for i in range(1, 7)], "id int, topic int")
    cover = lambda compat: coverage.coverage_by_topic(doc_topic, meta, matches, "article_id", compat).first()["n_covered"]
    assert cover(False) == 4 and cover(True) == 1
    people = spark.createDataFrame([(i, 1.0, 0.0) for i in range(1, 7)], "id int, Women double, Men double")
    domain, spoken = spark.createDataFrame([(0, "D")], "topic int, domain string"), spark.createDataFrame([(1, "en")], "id int, language string")
    base = lambda compat: {r["id"]: r["in_b"] for r in reports.analysis_base(doc_topic, meta, people, domain, spoken, matches, matches, compat=compat).collect()}
    assert [i for i, flag in sorted(base(False).items()) if flag == reports.INDEXED] == [1, 2, 3, 6]
    assert [i for i, flag in sorted(base(True).items()) if flag == reports.INDEXED] == [3]


def test_model_by_leaves_with_reranked_terms_and_labels(spark):
    words = ["soil nitrogen corn yield", "school teacher training policy", "protein folding membrane energy"]
    data = [(i, f"{words[i % 3]} {words[i % 3]} case {i}") for i in range(90)]
    texts = spark.createDataFrame(data, "id long, title string")
    embedder = lambda d: embedding.hashed_embedding(d, "id", "title", weighted=False)
    named = lambda info: info.where("topic = 0").select("topic", F.lit("0 - First").alias("label"))
    model = plans.model_topics(texts, None, part_size=45, min_samples=3, min_cluster_size=5, components=None, embedder=embedder, rerank=True, labeller=named)
    by_topic = {}
    for r in model.documents.collect():
        by_topic.setdefault(r["topic"], set()).add(r["id"] % 3)
    assert len([t for t in by_topic if t != -1]) >= 3 and all(len(groups) == 1 for t, groups in by_topic.items() if t != -1)
    info = {r["topic"]: r for r in model.info.collect()}
    assert info[0]["label"] == "0 - First" and all(i["label"].startswith(f"{t} - ") for t, i in info.items())
    kind = next(iter(by_topic[0]))
    assert set(" ".join(info[0]["representation"]).split()) <= set(words[kind].split()) | {"case"} | {str(i) for i in range(90)}
