from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pubmeter.llm.registered import QUERIES
from pubmeter.llm.spelling import count_words, group_variants, letter_runs, near_words, pivots, prefix


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def slow_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def slow_groups(count):
    # words one edit apart agree once a place is masked in both, or masked in one and opened in the other
    shapes = {}
    for w in count:
        for shape in {w[:k] + "?" + w[k + d :] for k in range(len(w) + 1) for d in (0, 1)}:
            shapes.setdefault(shape, []).append(w)
    pairs = {p for same in shapes.values() for p in combinations(sorted(same), 2)}
    near = {w: [] for w in count}
    for a, b in pairs:
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o.encode()), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    """Words with typos of typos, frequent words, and texts with what may go wrong."""
    rng = np.random.default_rng(5)
    letters = list("abcdefgéàÀ")
    words = ["".join(rng.choice(letters, int(rng.integers(7, 12)))) for _ in range(60)]
    for base in words[:20]:
        near = base
        for _ in range(6):
            k = int(rng.integers(0, len(near)))
            near = near[:k] + rng.choice(["", "x", near[k] + "y"]) + near[k + 1 :]
            words.append(str(near))
    weights = 1 / np.arange(1, len(words) + 1) ** 1.5
    texts = [" ".join(rng.choice(words, 80, p=weights / weights.sum())) for _ in range(150)]
    texts += [None, "", " \n", "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 49_999 + "y", "1234567", "Straße×÷ ÀÉÎÕÜß ÀÉÎÕÜß"]
    texts += ["abcdefgh " * 50] * 20 + ["abcdefxh " * 5] * 10 + ["abcdefxhh"] * 3
    rows = [(i, t.upper() if t and i % 5 == 0 else t, "extra", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "extra", 1), (None, texts[0], "extra", 1), *rows[:30]]
    folder = str(tmp_path_factory.mktemp("spelling"))
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").write.parquet(f"{folder}/documents.parquet")
    return folder, [(i, t) for i, t, _, _ in rows]


def test_query_against_brute_force(spark, tables):
    folder, rows = tables
    count = slow_words(rows)
    wanted = slow_groups(count)
    assert any(x[1] for x in wanted) and any(x[1] != x[2] and x[1] for x in wanted)
    assert found(QUERIES["op11_spelling"](spark, folder)) == wanted


def test_query_over_supplied_texts(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(QUERIES["op11_spelling"](spark, folder)) == slow_groups(slow_words(rows))


@given(st.dictionaries(st.integers(0, 20), st.integers(1, 9), min_size=4, max_size=12))
@settings(max_examples=300, deadline=None)
def test_pivots_are_the_cheapest_disjoint_pair(counts):
    a, b = pivots(sorted(counts.items()))
    wanted = min(x + y for (i, x), (j, y) in combinations(sorted(counts.items()), 2) if j - i >= 2)
    assert counts[a] + counts[b] == wanted and b - a >= 2


@given(st.text(st.sampled_from("abcé"), min_size=4, max_size=15), st.integers(0, 2**32 - 1))
@settings(max_examples=300, deadline=None)
def test_prefix(word, seed):
    counts = np.random.default_rng(seed).integers(1, 9, 1 << 16)
    found = prefix(word, counts)
    rank = {i: (int(counts[zlib.crc32(word[i : i + 2].encode()) % (1 << 16)]), word[i : i + 2], i) for i in range(len(word) - 1)}
    assert [p for p, _ in found] == sorted(sorted(rank, key=rank.get)[:3])


def test_every_near_pair_of_a_dense_vocabulary(spark):
    words = sorted({f"{a}{b}{c}{d}" for a in "ab" for b in "ab" for c in ("a", "b", "ab", "") for d in ("aa", "ab", "ba", "aab", "abb")} - {""})
    words = [w for w in words if len(w) >= 4]
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = {(words[r["a"]], words[r["b"]]) for r in near_words(df).collect()}
    assert got == {(a, b) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_near_pairs_of_random_words(spark):
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("aé漢"), int(rng.integers(4, 9)))) for _ in range(900)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = {(words[r["a"]], words[r["b"]]) for r in near_words(df).collect()}
    assert got == {(a, b) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_empty_and_odd_words(spark, odd, none):
    runs = none.select(F.explode(letter_runs(F.col("text"))).alias("word"))
    assert group_variants(count_words(runs)).count() == 0
    assert count_words(odd.select(F.explode(letter_runs(F.col("text"))).alias("word"))).where("word = 'sixteen'").count() == 0
    rows = [(None, 3), ("", 3), ("abc", 3), ("abcd", 30), ("abcde", 3)]
    got = found(group_variants(spark.createDataFrame(rows, "word string, n int")))
    assert got == sorted([(None, None, None, 3, 0, None), ("", None, "", 3, 0, None), ("abc", None, "abc", 3, 0, None), ("abcd", None, "abcd", 30, 1, None), ("abcde", "abcd", "abcd", 3, 1, 30)], key=str)
