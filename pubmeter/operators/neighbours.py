"""Exact nearest neighbours and similarity graphs over blocks of vectors.

Both sides are cut into hash blocks and Spark sends each pair of blocks to one task, which compares ``BLOCK`` rows of one with as
many of the other at a time by a matrix product. A task returns the best ``k`` rows per vector, or the edges of a
spanning forest: never all pairs. A side is cut into at most ``PIECES`` blocks as long as these have no more than ``LARGEST`` times ``BLOCK`` rows,
so what is shuffled grows with the rows and not with their square; beyond that a row is copied once per block of that size. Memory per task depends
on the largest block only. The comparisons are quadratic within
a group ``by``; study corpora are cut into row partitions first, which makes them linear in their number, and
``pubmeter.operators.buckets`` compares within buckets of hyperplanes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.ordering import first_rows

BLOCK = 1024
# Blocks of a side that is not too large for them, and sizes of ``BLOCK`` that a block may have.
PIECES = 16
LARGEST = 32
# Distances are rounded so that the order of a sum cannot change which neighbour is nearer.
DIGITS = 9


def nearest(
    left: DataFrame,
    right: DataFrame,
    k: int,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    metric: str = "cosine",
    skip_same_id: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest right rows of every left row: ``id, neighbour, distance, rank`` (and ``by``).

    Ties go to the smaller id.
    """
    one, other = _counted(_keyed(left, id, vec, by), _keyed(right, id, vec, by), block)
    found = best_in_cells(one, other, k, metric, skip_same_id, block)
    ranked = first_rows(found, ["_by", "id"], [F.asc("distance"), F.asc("neighbour")], k, "rank")
    return ranked.withColumnRenamed("_by", by) if by else ranked.drop("_by")


def best_in_cells(one: DataFrame, other: DataFrame, k: int, metric: str, skip_same_id: bool, block: int = BLOCK) -> DataFrame:
    """``_by, id, neighbour, distance``: of each pair of blocks of a group the ``k`` nearest rows of each left row.

    Both sides are ``_by, id, vec`` with the numbers ``_nl`` and ``_nr`` of blocks of their group on either side.
    """
    types = dict(one.dtypes)
    a, b = _cells(one, other, half=False)

    def best(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({"_by": [], "id": [], "neighbour": [], "distance": []})
        other = other.sort_values("id", kind="stable")
        left, right = np.stack(one["vec"].to_numpy()), np.stack(other["vec"].to_numpy())
        rows, cols, distances = [], [], []
        for part in _slices(len(left), block):
            held = (np.array([], dtype=int), np.array([], dtype=int), np.array([]))
            edge = np.full(part.stop - part.start, np.inf)
            for piece in _slices(len(right), block):
                d = _exact_distances(left[part], right[piece], metric)
                if skip_same_id:
                    _drop_same(d, one["id"].iloc[part], other["id"].iloc[piece])
                found = _closer(d, edge, k)
                if found[0].size:
                    # equal distances keep their order, and smaller ids come first
                    held = _first_of_rows(*(np.concatenate([old, new]) for old, new in zip(held, (found[0], found[1] + piece.start, found[2]))), k)
                    count = np.bincount(held[0], minlength=len(edge))
                    last = np.cumsum(count) - 1
                    edge = np.where(count == k, held[2][np.maximum(last, 0)], np.inf)
            for to, values in zip((rows, cols, distances), (held[0] + part.start, held[1], held[2])):
                to.append(values)
        return pd.DataFrame(
            {
                "_by": key[0],
                "id": one["id"].to_numpy()[np.concatenate(rows)],
                "neighbour": other["id"].to_numpy()[np.concatenate(cols)],
                "distance": np.concatenate(distances),
            }
        )

    schema = f"_by {types['_by']}, id {types['id']}, neighbour {dict(other.dtypes)['id']}, distance double"
    return a.cogroup(b).applyInPandas(best, schema)


def similarity_forest(
    df: DataFrame,
    radius: float,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    metric: str = "cosine",
    block: int = BLOCK,
) -> DataFrame:
    """Edges ``a, b`` with the same connected components as the graph of all pairs within ``radius``.

    Each pair of blocks contributes a spanning forest, grown from slice to slice, so it returns fewer edges than it has rows.
    """
    id_type = dict(df.dtypes)[id]
    one, other = _cells(*_counted(_keyed(df, id, vec, by), _keyed(df, id, vec, by), block), half=True)

    def forest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []})
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        # the component of every row of both sides, as far as it is known
        label = np.arange(len(a) + len(b))
        edges: list[tuple[int, int]] = []
        for part in _slices(len(a), block):
            for piece in _slices(len(b), block):
                columns = slice(len(a) + piece.start, len(a) + piece.stop)
                linked = (_distances(a[part], b[piece], metric) <= radius) & (label[part][:, None] != label[columns][None, :])
                if linked.any():
                    joined = [(part.start + i, piece.start + j) for i, j in zip(*(x.tolist() for x in spanning_forest(linked)))]
                    edges += _joining(label, joined, len(a))
        i, j = np.array(edges, dtype=int).reshape(-1, 2).T
        return pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j]})

    edges = one.cogroup(other).applyInPandas(forest, f"a {id_type}, b {id_type}")
    return edges.where("a <> b")


def pairs_within(df: DataFrame, radius: float, id: str = "id", vec: str = "vec", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """``a, b, distance``: all pairs of rows with ``a < b`` that lie within ``radius``. Ids are unique."""
    one, other = _cells(*_counted(_keyed(df, id, vec, None), _keyed(df, id, vec, None), block), half=True)
    id_type = dict(df.dtypes)[id]

    def close(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        parts = []
        for part in _slices(len(a), block):
            for piece in _slices(len(b), block):
                d = _distances(a[part], b[piece], metric)
                i, j = np.nonzero(d <= radius)
                parts.append((i + part.start, j + piece.start, d[i, j]))
        i, j, d = (np.concatenate(x) for x in zip(*parts))
        found = pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j], "distance": d})
        if key[1] == key[2]:
            return found[found["a"] < found["b"]]
        turned = found["a"] > found["b"]
        found.loc[turned, ["a", "b"]] = found.loc[turned, ["b", "a"]].to_numpy()
        return found

    return one.cogroup(other).applyInPandas(close, f"a {id_type}, b {id_type}, distance double")


def spanning_forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the edges of a spanning forest of a two-sided graph, breadth first."""
    rows_left, cols_left = linked.any(axis=1), linked.any(axis=0)
    out_i, out_j = [], []
    while rows_left.any():
        front = np.array([rows_left.argmax()])
        rows_left[front] = False
        while front.size:
            cols = np.flatnonzero(cols_left)
            part = linked[np.ix_(front, cols)]
            hit = part.any(axis=0)
            new_cols = cols[hit]
            out_i.append(front[part[:, hit].argmax(axis=0)] if new_cols.size else new_cols)
            out_j.append(new_cols)
            cols_left[new_cols] = False
            rows = np.flatnonzero(rows_left)
            part = linked[np.ix_(rows, new_cols)]
            hit = part.any(axis=1)
            front = rows[hit]
            out_i.append(front)
            out_j.append(new_cols[part[hit].argmax(axis=1)] if front.size else front)
            rows_left[front] = False
    if not out_i:
        return np.array([], dtype=int), np.array([], dtype=int)
    return np.concatenate(out_i), np.concatenate(out_j)


def _slices(rows: int, block: int) -> Iterator[slice]:
    return (slice(start, min(start + block, rows)) for start in range(0, rows, block))


def _drop_same(d: np.ndarray, left: pd.Series, right: pd.Series) -> None:
    """Distances between rows of one id become infinite."""
    shared = np.flatnonzero(left.isin(right).to_numpy())
    if shared.size:
        d[shared] = np.where(left.to_numpy()[shared][:, None] == right.to_numpy()[None, :], np.inf, d[shared])


def _closer(d: np.ndarray, edge: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded distances below the ``edge`` of their row, or the ``k`` smallest of each row where there is none yet."""
    if np.isinf(edge).any():
        d = np.round(d, DIGITS)
        pick = _smallest(d, min(k, d.shape[1]))
        rows, cols = np.repeat(np.arange(len(d)), pick.shape[1]), pick.ravel()
    else:
        # an edge is a rounded distance, so what does not lie below it does not when rounded
        rows, cols = np.nonzero(d < edge[:, None])
    found = np.round(d[rows, cols], DIGITS)
    keep = np.isfinite(found) & (found < edge[rows])
    return rows[keep], cols[keep], found[keep]


def _first_of_rows(rows: np.ndarray, cols: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each row with the smallest distance, ties to the smaller column, in that order."""
    order = np.lexsort((cols, distances, rows))
    rows, cols, distances = rows[order], cols[order], distances[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = place < k
    return rows[keep], cols[keep], distances[keep]


def _joining(label: np.ndarray, edges: list[tuple[int, int]], shift: int) -> list[tuple[int, int]]:
    """Those of the edges that join two components, one after another; ``label`` is brought up to date. Columns follow ``shift`` rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for i, j in edges:
        one, other = find(int(label[i])), find(int(label[shift + j]))
        if one != other:
            root[max(one, other)] = min(one, other)
            kept.append((i, j))
    moved = np.fromiter(root, dtype=label.dtype, count=len(root))
    to = np.arange(len(label))
    to[moved] = [find(int(x)) for x in moved]
    label[:] = to[label]
    return kept


def _counted(one: DataFrame, other: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of blocks of their group on the left and on the right.

    The pairs of blocks of a group are limited to ``PIECES`` times ``PIECES``, unless blocks get too large.
    """
    rows = _row_counts(one, "_l").join(_row_counts(other, "_r"), "_by")
    least = lambda c, size: F.ceil(F.col(c) / size)
    most = lambda c: F.greatest(F.lit(PIECES), F.floor(PIECES * PIECES / least(c, block)))
    pieces = lambda c, facing: F.greatest(F.least(least(c, block), most(facing)), least(c, LARGEST * block)).cast("int")
    counts = rows.select("_by", pieces("_l", "_r").alias("_nl"), pieces("_r", "_l").alias("_nr"))
    # one row per group, which the optimizer broadcasts where it is small enough
    return one.join(counts, "_by"), other.join(counts, "_by")


def lightest_bridges(df: DataFrame, metric: str, block: int = BLOCK) -> DataFrame:
    """``component, w, a, b, to``: for each component of ``_by`` its lightest pairs of rows with another one, one for each pair of blocks.

    ``df`` is ``_by, id, vec, component, core``; the weight of a pair is the largest of its distance and both cores.
    """
    copy = lambda: df.select(*(F.col(c).alias(c) for c in ("_by", "id", "vec", "component", "core")))
    one, other = _cells(*_counted(copy(), copy(), block), half=False, extra=("component", "core"))
    id_type, component_type = dict(df.dtypes)["id"], dict(df.dtypes)["component"]

    def lightest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["component", "w", "a", "b", "to"]
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        left, right = left.sort_values("id"), right.sort_values("id")
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        core, far, own, others = left["core"].to_numpy(), right["core"].to_numpy(), left["component"].to_numpy(), right["component"].to_numpy()
        weight, j = np.full(len(a), np.inf), np.zeros(len(a), dtype=int)
        for part in _slices(len(a), block):
            for piece in _slices(len(b), block):
                w = np.maximum(_distances(a[part], b[piece], metric), np.maximum(core[part][:, None], far[piece][None, :]))
                w[own[part][:, None] == others[piece][None, :]] = np.inf
                nearest_of = w.argmin(axis=1)
                least = w[np.arange(len(w)), nearest_of]
                better = least < weight[part]
                weight[part], j[part] = np.where(better, least, weight[part]), np.where(better, nearest_of + piece.start, j[part])
        columns = (own, weight, left["id"].to_numpy(), right["id"].to_numpy()[j], others[j])
        found = pd.DataFrame(dict(zip(names, columns)))
        return found[np.isfinite(found["w"])].sort_values(["w", "a", "b"]).drop_duplicates("component")

    return one.cogroup(other).applyInPandas(lightest, f"component {component_type}, w double, a {id_type}, b {id_type}, to {component_type}")


def _cells(one: DataFrame, other: DataFrame, half: bool, extra: tuple[str, ...] = ()):
    """Both sides grouped by (group, left block, right block); with ``half`` only pairs of ordered blocks."""
    first = F.col("_lb") if half else F.lit(0)
    a = one.withColumn("_lb", _block_of("_nl")).withColumn("_rb", F.explode(F.sequence(first, F.col("_nr") - 1)))
    b = other.withColumn("_rb", _block_of("_nr"))
    b = b.withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_rb") if half else F.col("_nl") - 1)))
    cell = ["_by", "_lb", "_rb"]
    return a.select(*cell, "id", "vec", *extra).groupBy(*cell), b.select(*cell, "id", "vec", *extra).groupBy(*cell)


def _keyed(df: DataFrame, id: str, vec: str, by: str | None) -> DataFrame:
    return df.select((F.col(by) if by else F.lit(0)).alias("_by"), F.col(id).alias("id"), F.col(vec).alias("vec"))


def _row_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("_by").agg(F.count(F.lit(1)).alias(name))


def _block_of(count: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return np.round(_exact_distances(a, b, metric), DIGITS)


def _exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances before they are rounded."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "euclidean":
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0.0))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    return 1.0 - _unit_rows(a) @ _unit_rows(b).T


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest values of each row, ties to the smaller column."""
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(d, pick, axis=1).max(axis=1)
    tied = np.flatnonzero((d <= edge[:, None]).sum(axis=1) > k)
    if tied.size:
        pick[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return pick
