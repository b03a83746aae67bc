"""Language of pages and features of toxic texts against plain loops."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pubmeter.llm import language, toxicity


def softmax(scores):
    top = max(scores)
    weights = [math.exp(s - top) for s in scores]
    return [w / sum(weights) for w in weights]


def slow_identify(pages, model):
    names = model.languages
    rows = []
    for key, url, html in pages:
        html = html or ""
        score = model.log_likelihoods(language.page_text(html)).tolist()
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = found[1].lower() if found else None
        rows.append((key, host, host and host.rpartition(".")[2], language.declared_language(html), score, softmax(score)))
    sums = {kind: defaultdict(lambda: [0.0] * len(names)) for kind in ("all", "suffix", "host", "said")}
    counts = {kind: defaultdict(int) for kind in ("all", "suffix", "host")}
    for _, host, suffix, declared, _, q in rows:
        for kind, value in (("all", 0), ("suffix", suffix), ("host", host)):
            if value is not None:
                counts[kind][value] += 1
                sums[kind][value] = [a + b for a, b in zip(sums[kind][value], q)]
        if declared in names:
            sums["said"][declared] = [a + b for a, b in zip(sums["said"][declared], q)]
    total = [sum(said[k] for said in sums["said"].values()) for k in range(len(names))]
    out = {}
    for key, host, suffix, declared, score, q in rows:
        fused = []
        for k in range(len(names)):
            prior = (sums["all"][0][k] + 1) / (len(rows) + len(names))
            less = lambda kind, value, k=k: max(sums[kind][value][k] - q[k], 0.0) if value is not None else 0.0
            others = lambda kind, value: max(counts[kind][value] - 1, 0) if value is not None else 0
            of_suffix = (less("suffix", suffix) + language.SUFFIX_WEIGHT * prior) / (others("suffix", suffix) + language.SUFFIX_WEIGHT)
            of_host = (less("host", host) + language.HOST_WEIGHT * of_suffix) / (others("host", host) + language.HOST_WEIGHT)
            markup = math.log((sums["said"][declared][k] + 1) / (total[k] + len(names))) if declared in names else 0.0
            fused.append(score[k] + math.log(of_host) + language.DECLARED_WEIGHT * markup)
        p = softmax(fused)
        best = max(range(len(names)), key=lambda k: (round(p[k], 12), -k))
        out[key] = (names[best], p[best], declared, host)
    return out


def test_fused_scores_of_supplied_pages(spark, folder):
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()] + [(-1, None, None), (-2, "no address", '<html lang="de">'), (-3, "https://u:p@X.Example.DE:80/a", "")]
    found = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, pages.schema).repartition(3), model).collect()}
    wanted = slow_identify(rows, model)
    assert set(found) == set(wanted)
    for key, (name, p, declared, host) in wanted.items():
        assert (found[key]["language"], found[key]["declared"], found[key]["host"]) == (name, declared, host)
        assert found[key]["probability"] == pytest.approx(p, abs=1e-9)


def slow_features(text, lexicon):
    words = text.split()
    weights, you = [], []
    for k, word in enumerate(words):
        bare = toxicity.plain(word)
        if bare in toxicity.SECOND_PERSON:
            you.append(k)
            weights.append(0.0)
        else:
            weights.append(max([lexicon.get(f"{bare}|", 0.0), *(lexicon.get(bare[:n], 0.0) for n in toxicity.PREFIXES if len(bare) >= n)]) if bare else 0.0)
    hits = [k for k, w in enumerate(weights) if w > 0]
    strong = [k for k, w in enumerate(weights) if w > 4]
    n, raw = max(1, len(words)), text.encode()
    letters = max(1, sum(b in toxicity.LETTER_BYTES for b in raw))
    top = sorted((weights[k] for k in hits), reverse=True)[:3] + [0.0] * 3
    close = sum(any(abs(k - y) <= toxicity.NEAR for y in you) for k in hits)
    signs, mixed = set("0134579@$!*.-"), 0
    for k in range(1, len(text) - 1):
        if text[k] in signs and text[k - 1].isascii() and text[k - 1].isalpha():
            end = k + 1
            while end < len(text) and text[end] in signs - set(".-"):
                end += 1
            mixed += end < len(text) and text[end].isascii() and text[end].isalpha()
    return [
        len(hits), len(hits) / n, sum(weights[k] for k in hits), sum(weights[k] for k in hits) / n, len(strong), len(strong) / n, *top[:3], close, len(you) / n,
        sum(b in toxicity.UPPER for b in raw) / letters, sum(b in toxicity.MARKS for b in raw) / max(1, len(raw)), sum(b in toxicity.PUNCTUATION for b in raw) / max(1, len(raw)), mixed / n, math.log1p(len(words)),
    ]


@given(st.lists(st.sampled_from(["you", "YOU", "idiot", "1d10t", "id-iot", "stu.pid", "Tu", "fine", "word!", "a*b", "é$", "12", "...", "ID!OT", "\n"]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_features_against_a_plain_loop(words):
    lexicon = {"idiot|": 5.0, "stu": 2.5, "fine|": 1.0}
    text = " ".join(words)
    assert np.allclose(toxicity.features(text, toxicity.Weights(lexicon)), slow_features(text, lexicon))
