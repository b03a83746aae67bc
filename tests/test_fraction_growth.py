"""Fractions of titles hold each title and author once."""

from pubmeter.plans.metadata import gender_fractions


def test_titles_and_authors_are_held_once(spark):
    pubs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", None), (None, 1), ("c", 4)], "title string, author_id long")
    inference = spark.createDataFrame([(1, "F"), (1, "F"), (2, "M"), (3, "F"), (3, "M"), (4, "unknown"), (None, "F")], "author_id long, gender string")
    found = gender_fractions(pubs, inference)
    assert {tuple(r) for r in found.collect()} == {("a", 0.5, 0.5), ("b", 0.0, 1.0), (None, 1.0, 0.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # copies are looked for among the pairs and in the small table, not among their joined rows
    assert plan.count("Aggregate [title") == 2
