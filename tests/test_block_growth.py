"""Blocks of vectors whose number is bounded, compared slice by slice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeter.operators import clustering, neighbours
from pubmeter.session import cut_lineage


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, vec array<double>")


def test_copies_of_a_vector_do_not_grow_with_the_rows(spark):
    rows = spark.range(3_000).select(F.lit(0).alias("_by"), "id")
    one, other = neighbours._counted(rows, rows, 25)
    assert (one.first()["_nl"], other.first()["_nr"]) == (16, 16)
    few = rows.where("id < 5")
    one, other = neighbours._counted(rows, few, 25)
    assert (one.first()["_nl"], other.first()["_nr"]) == (120, 1)


@pytest.mark.parametrize("k", [3, 12])
def test_nearest_in_slices_of_a_block(spark, k):
    m = np.random.default_rng(3).integers(-2, 3, (420, 3)).astype(float)
    got = neighbours.nearest(vectors(spark, m), vectors(spark, m), k, metric="euclidean", skip_same_id=True, block=10).collect()
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), neighbours.DIGITS)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    expected = {(i, r + 1): (int(j), d[i, j]) for i in range(len(m)) for r, j in enumerate(order[i])}
    assert {(r.id, r["rank"]): (r.neighbour, r.distance) for r in got} == expected


def test_forest_of_a_block_of_many_slices(spark):
    m = np.random.default_rng(5).normal(size=(500, 2))
    edges = cut_lineage(neighbours.similarity_forest(vectors(spark, m), 0.12, metric="euclidean", block=10))
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)).round(neighbours.DIGITS) <= 0.12
    label = np.arange(len(m))
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            break
        label = low
    found = {r.id: r.component for r in clustering.connected_components(edges).collect()}
    assert {i: found.get(i, i) for i in range(len(m))} == dict(enumerate(label.tolist()))


def test_bridges_do_not_depend_on_slices(spark):
    m = np.random.default_rng(7).normal(size=(400, 2))
    rows = vectors(spark, m).select(F.lit(0).alias("_by"), "id", "vec", (F.col("id") % 4).alias("component"), F.lit(0.01).alias("core"))
    lightest = lambda block: {r.component: r.edge for r in neighbours.lightest_bridges(rows, "euclidean", block).groupBy("component").agg(F.min(F.struct("w", "a", "b", "to")).alias("edge")).collect()}
    assert lightest(10) == lightest(1024)
