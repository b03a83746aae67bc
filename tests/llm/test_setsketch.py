from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pubmeter.llm import setsketch
from pubmeter.llm.setsketch import estimate, least_estimate, minima, near_duplicates, registers, shingles
from tests.llm.test_near_and_repeats import reach


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def slow_groups(texts):
    sets = [slow_set(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    return reach(links, range(len(sets))), sets


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for size in (3, 40, 3_000):
        for share in (0.3, 0.6, 0.85, 1.0):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, size * 2, dtype=np.uint64)
                common = int(round(size * 2 * share / (1 + share)))
                a, b = both[:size], both[size - common : 2 * size - common]
                low = minima(a), minima(b)
                assert (minima(np.concatenate([a, b])) == np.minimum(*low)).all()
                x, y = map(registers, low)
                assert (registers(np.minimum(*low)) == np.maximum(x, y)).all()
                true = common / (2 * size - common)
                guess = estimate(x[None], y[None], np.array([size * 1.0]), np.array([size * 1.0]))[0]
                errors.append((guess - true) / max(0.01, (true * (1 - true) / setsketch.REGISTERS) ** 0.5))
    assert abs(np.mean(errors)) < 0.3 and np.std(errors) < 1.4
    assert 0.65 < least_estimate(85) < 0.85


def test_shingles_are_the_same_in_any_block(monkeypatch):
    text = " ".join(f"W{k % 97} é{k % 13}" for k in range(500))
    whole, low = shingles(text), minima(shingles(text))
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    assert (shingles(text) == whole).all() and (minima(whole) == low).all()
    assert len(whole) == len(slow_set(text))


@pytest.fixture
def copies():
    """Groups of near copies of every similarity around the limit, chains among them, that share a passage."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(5):
        base = [word() for _ in range(int(rng.integers(60, 200)))] + passage
        for _ in range(30):
            text = list(base)
            for k in rng.integers(0, len(text), int(rng.integers(0, 9))):
                text[k] = word()
            out.append("  ".join(text).upper())
            base = text if rng.random() < 0.2 else base
    out += out[:20] + ["a b c", "a b", "a b", "A  B", "b a", "", " \n", None, None]
    return [out[k] for k in rng.permutation(len(out))]


def test_against_brute_force(spark, copies):
    label, sets = slow_groups(copies)
    assert 20 < len(set(label.values())) < len(copies) - 60
    docs = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in enumerate(copies)], "doc_id long, text string, n int, set string, component string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert found == {i: (len(sets[i]), label[i]) for i in range(len(copies))}


def test_rare_shingles_alone_find_every_link(spark, copies, monkeypatch):
    """Without a single link from the rounds the last step must find all."""
    monkeypatch.setattr(setsketch, "least_estimate", lambda percent: 2.0)
    label, _ = slow_groups(copies)
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == label


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    label, sets = slow_groups([t for _, t in rows])
    smallest = {k: min((rows[j][0] for j in label if label[j] == k and rows[j][0] is not None), default=None) for k in set(label.values())}
    wanted = Counter((i, len(sets[k]), smallest[label[k]] if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect()) == wanted
    assert near_duplicates(none).count() == 0
