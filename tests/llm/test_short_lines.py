from __future__ import annotations

import corpus_pipeline
from pubmeter.llm.lines import drop_boilerplate


def texts(spark):
    """A short line at all 20 sites, another at 17 of them, a blank one, and a long one at five."""
    rows = []
    for k in range(40):
        text = ["All rights reserved.", " ", f"own text of the document {k}", "All rights reserved."]
        text += ["Of."] * (k % 20 < 17) + ["this line has five words"] * (k % 20 < 5)
        rows.append((k, "\n".join(text), "en", f"s{k % 20}", len("\n".join(text))))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def expected(k):
    out = ["All rights reserved."] * (k == 0) + [" ", f"own text of the document {k}"]
    return "\n".join(out + ["Of."] * (k % 20 < 17) + ["this line has five words"] * (k == 0))


def test_stage_counts_short_lines(spark):
    docs = texts(spark)
    found = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {k: expected(k) for k in range(40)}
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


def test_short_lines_of_other_shares(spark):
    docs = texts(spark)
    removed = lambda **more: {r["doc_id"]: r["n_lines_removed"] for r in drop_boilerplate(docs, **more).collect()}
    long = lambda k: int(k % 20 < 5 and k > 0)
    assert removed() == {k: long(k) for k in range(40)}
    assert removed(short=0.85) == {k: long(k) + (2 if k else 1) + int(k % 20 < 17 and k > 0) for k in range(40)}
    assert drop_boilerplate(docs.where("doc_id > 99"), short=0.9).count() == 0
