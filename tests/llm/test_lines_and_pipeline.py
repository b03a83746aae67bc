from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pubmeter.llm import queries
from pubmeter.llm.lines import drop_boilerplate
from pubmeter.llm.registered import table
from tests.llm.test_near_and_repeats import slow_print


def slow_lines(rows, sites, words=5):
    where, first = defaultdict(set), {}
    for key, (i, text, site) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= words:
                where[line].add(site)
                first.setdefault(line, (i, key, pos))
                first[line] = min(first[line], (i, key, pos))
    bad = {line for line, s in where.items() if len(s - {None}) >= sites}
    out = []
    for key, (i, text, _) in enumerate(rows):
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for pos, x in enumerate(lines) if x not in bad or first[x] == (i, key, pos)]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("sites", [2, 5, 40])
def test_boilerplate_lines(spark, sites):
    line = lambda k: f"this is the line of number {k}"
    rows = [(i, "\n".join([line(i % 7), "short", "", f"own text of document {i} only", line(i % 3), line(i % 3)]), f"s{i % (1 + i % 50)}" if i % 9 else None) for i in range(200)]
    rows += [(300, None, "s1"), (301, "", "s2"), (302, "\n\n", "s3"), (303, line(0) * 20_000, "s4"), (304, line(0), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("x")).withColumn("n_lines_removed", F.lit(7))
    found = drop_boilerplate(docs, sites=sites)
    assert found.columns == ["doc_id", "text", "source", "key", "n_lines_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_lines_removed"]) for r in found.collect()) == slow_lines(rows, sites)


def test_boilerplate_of_odd_rows(odd, none):
    found = drop_boilerplate(odd, sites=1)
    assert found.count() == odd.count()
    assert found.columns[:-1] == odd.columns
    assert drop_boilerplate(none).count() == 0


def test_registered():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, folder).cache()
    assert clean.columns == columns
    insult = re.compile(r"\b(idiot|moron|stupid|scum|clown|trash|loser)\b")
    gone = set(rows) - {r["doc_id"] for r in clean.collect()}
    assert sum(bool(insult.search(rows[i]["text"])) for i in gone) >= 0.5 * len(gone) - 1

    lines = stage["line dedup"](spark, clean, folder).cache()
    assert lines.columns == columns
    before = sorted((r["doc_id"], r["text"], r["source"]) for r in clean.collect())
    assert Counter((r["doc_id"], r["text"]) for r in lines.collect()) == Counter((i, t) for i, t, _ in slow_lines(before, 5))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stage["near-duplicates"](spark, lines, folder).cache()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in lines.collect()}
    label = {i: i for i in prints}
    again = True
    while again:
        again = False
        for i in prints:
            low = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            again |= low < label[i]
            label[i] = min(label[i], low)
    assert {r["doc_id"] for r in single.collect()} == set(label.values())
    assert single.columns == columns

    mixed = stage["mixing"](spark, single, folder).cache()
    assert mixed.columns == columns
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}

    pieces = stage["packing"](spark, mixed, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.collect()}
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_stages_on_odd_rows(spark, odd, none, folder):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "key")
    for start in (docs, none.select(*docs.columns)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() >= now.select("doc_id").distinct().count()
