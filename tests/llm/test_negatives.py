from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pubmeter.llm import negatives
from pubmeter.llm.negatives import exact_scores, first_columns, mine, primes_for


@given(st.integers(1, 200), st.integers(0, 45), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_scores_are_exact(wide, bits, seed):
    rng = np.random.default_rng(seed)
    most = max(1, math.isqrt((1 << bits) // wide))
    a, b = (rng.integers(-most, most + 1, (n, wide)) for n in (7, 9))
    assert (exact_scores(a, b, primes_for(wide * most * most)) == a @ b.T).all()


def test_primes():
    assert primes_for(500) == [1021]
    product = math.prod(primes_for(1 << 50))
    assert 2**51 < product < 2**62


def test_first_columns():
    scores = np.array([[5, 7, 7, 1], [1, 2, 3, 4], [9, 9, 9, 9]])
    wanted = np.array([[True, True, True, True], [False, True, False, False], [False] * 4])
    found = [(r, c) for rows, columns in first_columns(scores, wanted, 3) for r, c in zip(rows.tolist(), columns.tolist())]
    assert sorted(found) == [(0, 0), (0, 1), (0, 2), (1, 1)]


def slow(rows, every=10):
    rows = [(k, i, l, [math.floor(256 * x) for x in v]) for k, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda i: (i is None, i or 0)
    out = []
    for k, i, l, v in rows:
        if i is None or i % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, m, n) for n, j, m, w in rows if n != k), key=lambda s: (-s[0], order(s[1]), s[3]))
        for positive, j, _, _ in [s for s in scored if s[2] == l][:5]:
            hard = [s for s in scored if s[2] != l and 80 * positive <= 100 * s[0] <= 100 * positive][:5]
            out += [(i, j, r, s[1], positive, s[0]) for r, s in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 8192])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", max(2, block // 3))
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([-0.3, 0.1, 0.25, 1.0], 8)], int(rng.integers(0, 3))) for i in range(80)]
    rows += [(100, None, 1), (110, [1.0] * 8, None), (120, [float("nan")] * 8, 1), (130, [None] + [1.0] * 7, 1), (140, [float("inf")] * 8, 1)]
    rows += [(150, [], 1), (160, [1.0, 0.5], 2), (170, [0.2] * 11, 0), (None, [0.9] * 8, 1), (None, [0.9] * 8, 2), rows[10], rows[20], rows[33]]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, key string, score int").repartition(3)
    single = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]
    found = mine(df, F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == slow(single)


def test_without_anchors_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [0.9], 1)], "vec_id long, embedding array<float>, label int")
    for part in (df, df.where("vec_id > 5"), df.where("vec_id = 1")):
        assert mine(part, F.col("vec_id") % 10 == 0).count() == 0
    assert mine(df, F.col("vec_id") == 1).count() == 0
    with pytest.raises(ValueError, match="largest"):
        mine(spark.createDataFrame([(0, [1e30], 0)], df.schema), F.col("vec_id") == 0)
