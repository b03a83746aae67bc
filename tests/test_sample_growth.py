"""The articles behind a check sample are worked out once."""

from pyspark.sql import functions as F

from pubmeter.plans.validation import unmatched_article_sample
from pubmeter.session import cut_lineage


def test_open_articles_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def unmatched(article):
        worked.add(1)
        return article % 4 == 0

    rows = spark.createDataFrame([(i, f"d{i % 3}", f"name {n}") for i in range(40) for n in range(2)], "article_id long, discipline string, first_name string")
    matched = rows.select("article_id", "discipline").distinct().withColumn("matched", unmatched("article_id"))
    cut_lineage(matched.where("not matched"))
    once = worked.value
    found = unmatched_article_sample(rows, matched, size=10).collect()
    assert len(found) == len({r.article_id for r in found}) == 10
    assert all(r.article_id % 4 for r in found)
    assert worked.value == 2 * once
