from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pubmeter.operators import counting, membership, ordering, sampling, skew, statistics


# --- joins --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, another part has none."""
    data = [(i, 7 if i % 3 == 0 else (None if i % 5 == 0 else i % 40)) for i in range(3000)]
    return spark.createDataFrame(data, "id int, k int").repartition(8)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, rows, hot, how):
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 2)] + [(7, "seven"), (7, "again"), (None, "none")], "k int, v string")
    plain = hot.join(right, "k", how)
    assert rows(skew.skew_join(hot, right, "k", how, profile=hot), *plain.columns) == rows(plain)
    assert rows(skew.skew_join(hot, right, "k", how), *plain.columns) == rows(plain)


def test_skew_join_null_safe(spark, rows, hot):
    right = spark.createDataFrame([(7, "seven"), (None, "none"), (8, "eight")], "k int, v string")
    expected = hot.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    assert rows(skew.skew_join(hot, right, "k", "left", profile=hot, null_safe=True), "id", "k", "v") == rows(expected, "id", "k", "v")


def test_hot_keys_are_found_and_spread(spark, hot):
    found = spark.range(1).select(skew.hot_hashes(hot, ["k"], 0.1).alias("h"), F.xxhash64(F.lit(7)).alias("seven")).first()
    assert found["h"] == [found["seven"]]
    right = spark.createDataFrame([(7, "seven")], "k int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.skew_join(hot, right, "k", "inner", profile=hot)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == hot.where("k = 7").count() and max(sizes) < 0.6 * sum(sizes)


def test_membership_treats_missing_as_a_value(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    without, with_null = (spark.createDataFrame(x, "k int") for x in ([(1,), (1,)], [(1,), (None,)]))
    assert rows(membership.with_flag(df, without, "k", "f")) == [(None, False), (1, True), (2, False)]
    assert rows(membership.with_flag(df, with_null, "k", "f")) == [(None, True), (1, True), (2, False)]
    assert rows(membership.members(df, with_null, "k")) == [(None,), (1,)]
    assert rows(membership.non_members(df, with_null, "k")) == [(2,)]
    assert rows(membership.non_members(df, without, "k")) == [(None,), (2,)]


def test_group_any(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None)], "g int, x int")
    flagged = membership.group_any(df, "g", F.col("x") == 1, "f")
    assert rows(flagged, "g", "f") == [(1, True), (1, True), (2, False), (3, False)]


# --- counts -------------------------------------------------------------------------------------------


def test_distinct_counts_with_missing(spark, rows):
    df = spark.createDataFrame([("t", 1, "en"), ("t", 2, "pt"), ("t", 3, None), ("t", 1, "en")], "topic string, id int, lang string")
    english = {"n_en": F.col("lang") == "en"}
    assert rows(counting.distinct_counts(df, ["topic"], "id", english)) == [("t", 1, 3)]
    assert rows(counting.distinct_counts(df, ["topic"], "id", english, missing_counts=True)) == [("t", 2, 3)]


def test_missing_key_counts_once(spark, rows):
    df = spark.createDataFrame([(1,), (None,), (None,)], "id int")
    assert rows(counting.distinct_counts(df, [], "id")) == [(1,)]
    assert rows(counting.distinct_counts(df, [], "id", missing_counts=True)) == [(2,)]


def test_fractional_shares(spark, rows):
    data = [("a", 1, "Women"), ("a", 2, "Women"), ("a", 3, "Men"), ("a", 4, "unknown"), ("a", 1, "Women"), ("b", 5, "unknown")]
    df = spark.createDataFrame(data, "title string, author int, gender string")
    shares = counting.fractional_shares(df, "title", "author", "gender", ["Women", "Men"])
    assert rows(shares) == [("a", pytest.approx(2 / 3), pytest.approx(1 / 3))]


def test_dominant_category(spark, rows):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 1), (2, "A", 55), (2, "B", 45), (3, "A", 1)], "t int, domain string, n int")
    result = counting.dominant_category(df, "t", "domain", "n", 0.55, "Multidisciplinary")
    assert rows(result) == [(1, "Multidisciplinary"), (2, "A"), (3, "A")]


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (None, 100.0)], "x double, w double")
    assert df.agg(counting.weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.5


def test_representation_ratio(spark, rows):
    data = [(1, "D", "Indexed", 1.0, 0.0), (2, "D", "Indexed", 0.5, 0.5), (3, "D", "Not", 0.0, 1.0), (4, None, "Indexed", 1.0, 0.0)]
    base = spark.createDataFrame(data, "id int, domain string, flag string, Women double, Men double")
    out = counting.representation_ratio(base, "flag", "Indexed", "domain", "id", ["Men", "Women"])
    found = {(r["domain"], r["gender"]): r["x"] for r in out.collect()}
    assert found[("D", "Women")] == pytest.approx(1 / (2 / 3) - 1)
    assert found[("D", "Men")] == pytest.approx((0.5 / 1.5) / (2 / 3) - 1)
    assert found[(None, "Women")] == 0 and found[(None, "Men")] is None


# --- order --------------------------------------------------------------------------------------------


def test_row_index_is_a_permutation(spark):
    ids = random.Random(1).sample(range(10**6), 5000)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, name string").repartition(7)
    by_number = {r["id"]: r["row_index"] for r in ordering.row_index(df, "id").collect()}
    assert [by_number[i] for i in sorted(ids)] == list(range(5000))
    by_text = sorted((r["name"], r["row_index"]) for r in ordering.row_index(df, "name").collect())
    assert [n for _, n in by_text] == list(range(5000))


def test_average_rank(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "x int")
    assert rows(ordering.average_rank(df, "x")) == [(1, 1, 1.0), (2, 2, 2.5), (5, 1, 4.0)]


def test_top_with_ties(spark, rows):
    df = spark.createDataFrame([(5,), (4,), (4,), (1,), (None,)], "x int")
    assert rows(ordering.top_with_ties(df, "x", 2)) == [(4,), (4,), (5,)]
    assert rows(ordering.top_with_ties(df, "x", 1, ascending=True)) == [(1,)]
    assert len(rows(ordering.top_with_ties(df, "x", 5))) == 5
    assert len(rows(ordering.top_with_ties(df, "x", 9))) == 5
    assert len(rows(ordering.extremes(df, "x", 4))) == 8


def test_first_rows_beyond_the_map_side_limit(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), "id")
    kept = ordering.first_rows(df, ["g"], [F.asc("id")], 1500)
    assert {r["g"]: (r["n"], r["m"]) for r in kept.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()} == {
        0: (1500, 2998),
        1: (1500, 2999),
    }


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "x", 1)], "k string, y string, z int")
    assert rows(ordering.first_per_key(df, ["k"])) == [("a", "x", 1)]


def test_map_side_limit_is_planned(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    ordering.first_rows(df, ["g"], [F.asc("id")], 1).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


# --- samples ------------------------------------------------------------------------------------------


def test_sample_does_not_depend_on_partitioning(spark, rows):
    df = spark.range(500).select((F.col("id") % 4).alias("s"), "id")
    first = rows(sampling.sample_per_stratum(df, ["s"], 5))
    assert first == rows(sampling.sample_per_stratum(df.repartition(13), ["s"], 5)) and len(first) == 20
    assert first != rows(sampling.sample_per_stratum(df, ["s"], 5, seed=99))


def test_quota_sums_to_size(spark):
    sizes = {"a": 333, "b": 333, "c": 334, "d": 5, "e": 1}
    df = spark.createDataFrame([(k, f"{k}{i}") for k, n in sizes.items() for i in range(n)] + [(None, "x")], "s string, id string")
    for size in (10, 37, 100):
        quotas = {r["s"]: r["quota"] for r in sampling.proportional_quota(df, "s", "id", size).collect()}
        assert sum(quotas.values()) == size and set(quotas) == set(sizes)
        assert sampling.proportional_sample(df, "s", "id", size).count() == size


def test_manual_quota(spark):
    df = spark.createDataFrame([("Arts", 1), ("Law", 2), ("Law", 3), ("Law", 4)], "s string, id int")
    quotas = {r["s"]: r["quota"] for r in sampling.proportional_quota(df, "s", "id", 10, {"Arts": 1}).collect()}
    assert quotas == {"Arts": 3, "Law": 8}


# --- statistics ---------------------------------------------------------------------------------------


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 1.0), (5.0, 9.0), (None, 1.0)], "x double, y double")
    row = statistics.spearman(df, "x", "y").first()
    assert row["n"] == 4 and row["r"] == pytest.approx(0.5)
    assert row["t"] == pytest.approx(0.5 * math.sqrt(2 / 0.75))
    assert row["s"] == pytest.approx((64 - 4) * 0.5 / 6)


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 5, 1.0), (2.570582, 5, 0.05), (1.959964, 10**7, 0.05), (12.7062, 1, 0.05), (-2.2281389, 10, 0.05)])
def test_student_p(t, df, p):
    assert statistics.student_p(t, df) == pytest.approx(p, rel=1e-4)


def test_density_grid_integrates_to_one(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([("g", rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(200)], "g string, x double, y double")
    cells = statistics.density_grid(points, "g", "x", "y", 40).collect()
    xs, ys = sorted({r["x"] for r in cells}), sorted({r["y"] for r in cells})
    area = (xs[1] - xs[0]) * (ys[1] - ys[0])
    assert len(cells) == 1600 and 0.85 < sum(r["density"] for r in cells) * area < 1.02


def test_quadrants(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, 1.0)], "x double, y double")
    label = statistics.quadrant(F.col("x"), F.col("y"), F.lit(0.5), F.lit(0.5), "abcd", "?")
    assert [r[0] for r in df.select(label).collect()] == ["a", "b", "c", "d", "?"]
