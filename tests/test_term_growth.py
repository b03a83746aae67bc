"""Counts of terms meet in one shuffle, and their weights in none."""

from pyspark.sql import functions as F

from pubmeter.operators import tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rows = [(i, i % 3 if i % 10 else None, f"alpha beta w{i % 7} w{i % 5}" if i % 11 else "") for i in range(200)]
    return spark.createDataFrame(rows, "id long, topic int, title string")


def test_counts_meet_by_term_in_one_shuffle(spark):
    counts = tokens.term_counts(texts(spark), "topic", "title", ["alpha"])
    assert plan(counts.groupBy("term").agg(F.sum("n"))).count("Exchange hashpartitioning") == 1


def test_counts_of_words_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GATHERED", 1)
    monkeypatch.setattr(tokens, "HELD", 1)
    found = {(r.topic, r.term): r.n for r in tokens.term_counts(texts(spark).repartition(5), "topic", "title", ["alpha"]).collect()}
    expected = {}
    for r in texts(spark).collect():
        words = [w for w in r.title.split() if w != "alpha"]
        for term in words + [" ".join(p) for p in zip(words, words[1:])]:
            expected[r.topic, term] = expected.get((r.topic, term), 0) + 1
    assert found == expected


def test_weights_do_not_meet_by_topic(spark):
    rows = [(t, f"term {i} of many {i * 7919}", 1 + i % 5) for t in range(3) for i in range(t, 2_000)]
    counts = spark.createDataFrame(rows, "topic int, term string, n long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        found = plan(tokens.top_terms(tokens.class_tfidf(counts, max_df=1.0)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in found
    assert "row_number(), 10, Partial" in found
