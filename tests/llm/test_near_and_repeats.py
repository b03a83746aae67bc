from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pubmeter.llm import suffixes
from pubmeter.llm.common import components
from pubmeter.llm.simhash import close_pairs, drop_near_duplicates, fingerprint, forest, near_duplicates
from pubmeter.llm.suffixes import remove_repeats


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(st.sampled_from("aB é\n"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text) == slow_print(text)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.lists(st.tuples(st.integers(0, 29), st.lists(st.integers(0, 63), max_size=4)), max_size=60))
@settings(max_examples=150, deadline=None)
def test_trie_walk_finds_every_close_pair(seeds, changes):
    values = set(seeds)
    for k, bits in changes:
        if seeds:
            x = seeds[k % len(seeds)]
            for b in bits:
                x ^= 1 << b
            values.add(x)
    a = np.array(sorted(values), np.uint64)
    near = lambda x, y: np.bitwise_count(x[:, None] ^ y[None, :]) <= 3
    got = {(i, j) for x, y in close_pairs(a, a, True) for i, j in zip(x.tolist(), y.tolist())}
    assert got == set(zip(*np.nonzero(np.triu(near(a, a), 1)))) if len(a) else not got
    b = a[::2]
    got = {(i, j) for x, y in close_pairs(a, b, False) for i, j in zip(x.tolist(), y.tolist())}
    assert got == (set(zip(*np.nonzero(near(a, b)))) if len(a) else set())
    assert len(forest(a, a, True)[0]) <= max(0, len(a) - 1)


def reach(pairs, all_ids):
    label = {i: i for i in all_ids}
    again = True
    while again:
        again = False
        for a, b in pairs:
            low = min(label[a], label[b])
            again |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("node", [4, 1 << 14])
def test_near_duplicates(spark, odd, node):
    base = "the quick brown fox jumps over a lazy dog while seven wise owls watch from high branches"
    rows = [(100 + k, base + " indeed" * (k % 3) + f" {k}" * (k % 5 == 4)) for k in range(40)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, slow_print(t)) for i, t in rows]
    first = defaultdict(list)
    for i, p in prints:
        first[p].append(i)
    label = reach([(a, b) for a in first for b in first if (a ^ b).bit_count() <= 3], list(first))
    smallest = {p: min(i for q in first if label[q] == label[p] for i in first[q] if i is not None) for p in first}
    found = near_duplicates(docs, node=node).collect()
    assert Counter((r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in found) == Counter((i, p, smallest[p]) for i, p in prints)
    kept = drop_near_duplicates(docs, node=node)
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter({*smallest.values(), None})


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    a, b = "a long text about the winter in the northern hills and its many storms", "quite another text that tells of boats on the wide and slow river"
    rows = [(0, b), (1, a), (1, b), (4, a + "  "), (4, "unlike all of the others in every single one of its words"), (5, a), (5, a), (None, b)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    kept = drop_near_duplicates(docs)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([rows[0], rows[1], rows[4], rows[7]])
    assert kept.columns == docs.columns


def test_near_duplicates_of_nothing(none):
    assert near_duplicates(none).count() == 0
    assert drop_near_duplicates(none).columns == none.columns


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
    found = components(edges.unionByName(spark.createDataFrame([(100, 101), (100, 100)], "a long, b long"))).collect()
    assert {r["id"]: r["component"] for r in found} == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}


def slow_removal(rows, length):
    seen = Counter(x[i : i + length] for _, x in rows for i in range(len(x) - length + 1))
    out = []
    for key, x in rows:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(v for v, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("together", "local"), [(4096, 1 << 18), (1, 1 << 18), (1, 2000)])
def test_repeated_strings(spark, odd, monkeypatch, together, local):
    monkeypatch.setattr(suffixes, "LOCAL", local)
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgé "), n))
    passage, exactly, below = noise(400), "q" + noise(300).encode()[:199].decode(errors="ignore"), noise(150)
    rows = [(100 + k, noise(int(rng.integers(0, 500))) + [passage, exactly, below, passage[: 190 + k]][k % 4] + noise(int(rng.integers(0, 90)))) for k in range(60)]
    rows += [(200, "ab" * 400), (201, "z" * 199), (202, "z" * 200), (203, "y" * 201), (204, passage), (205, passage + passage)]
    rows += [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = remove_repeats(docs, together=together).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
    assert got == slow_removal([(i, (t or "").encode()) for i, t in rows], 200)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(rng.choice(list("abcdefg "), n))
    shared = noise(900)
    rows = [(1, noise(3000) + shared + noise(1100)), (2, noise(123) + shared), (3, shared[:500] + noise(2000))]
    assert got_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_removal([(i, t.encode()) for i, t in rows], 200)


def got_of(found):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect())


def test_repeats_of_nothing(none):
    assert remove_repeats(none).count() == 0
