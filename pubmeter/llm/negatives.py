"""Hard negatives: exact integer scores by matrix products modulo small primes, then selection in windows of the score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmeter.llm.common import in_small_batches, keyed
from pubmeter.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative scores at least LOW and at most HIGH hundredths of the positive.
LOW = 80
HIGH = 100
# Rows of a block of vectors, of a block of anchors, and anchors that are scored at once.
BLOCK = 8_192
ANCHORS = 1_024
TOGETHER = 128
# Products of residues are summed in float32, which holds whole numbers up to 2**24: with residues of at most half a prime below
# 1,024, 64 products at a time stay below it.
PRIME_BELOW = 1_024
SUMMED = 64
# Beyond this the product of the primes, and the window's hundredths of a score, would not fit 64-bit integers.
LARGEST = 1 << 50
NO_ID = np.iinfo(np.int64).max


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW, so many that their product tells apart whole numbers from -bound to bound."""
    chosen, product = [], 1
    for p in range(PRIME_BELOW - 1, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            chosen.append(p)
            product *= p
    return chosen


def residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """``matrix`` modulo ``prime``, between minus and plus half of it, as float32."""
    r = np.mod(matrix, prime)
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Inner products of the integer rows of ``a`` and ``b``, whose absolute values the primes' product exceeds twice.

    One float32 product per prime and SUMMED columns, exact modulo that prime; the residues are put together by Chinese
    remaindering in mixed radix, and the upper half of the range stands for negative scores.
    """
    value = np.zeros((len(a), len(b)), np.int64)
    product = 1
    for p in primes:
        x, y = residues(a, p), residues(b, p)
        total = np.zeros(value.shape, np.int32)
        for k in range(0, a.shape[1], SUMMED):
            total = np.mod(total + (x[:, k : k + SUMMED] @ y[:, k : k + SUMMED].T).astype(np.int32), p)
        digit = np.mod((total - np.mod(value, p)) * pow(product, -1, p), p)
        value += digit * product
        product *= p
    return np.where(value > product // 2, value - product, value)


def first_columns(scores: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, columns`` of the up to ``k`` highest wanted scores of each row; of equal ones the first column."""
    low = np.iinfo(np.int64).min
    left = np.where(wanted, scores, low)
    rows = np.flatnonzero(wanted.any(axis=1))
    left = left[rows]
    for _ in range(k):
        if not len(rows):
            return
        best = left.argmax(axis=1)
        there = left[np.arange(len(rows)), best] > low
        rows, best, left = rows[there], best[there], left[there]
        yield rows, best
        left[np.arange(len(rows)), best] = low


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """The whole numbers ``floor(scale * x)`` of the components; missing where the vector or a component is missing or not finite."""
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * float(scale))))


def _blocks(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """One row per block of about ``size`` of the ``n`` rows ``key, id, label, q`` and, of anchors, ``least``, ordered by id."""
    limits = "least" in rows.columns

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        keys = table["key"].to_numpy()
        order = np.lexsort((keys, ids))
        vectors = table["q"].to_pylist()
        matrix = np.zeros((len(order), max(map(len, vectors))), np.int64)
        for to, k in enumerate(order):
            matrix[to, : len(vectors[k])] = vectors[k]
        columns = {"block": [table["block"][0].as_py()], "rows": [len(order)], "keys": [keys[order].tobytes()], "ids": [ids[order].tobytes()]}
        columns |= {"labels": [table["label"].to_numpy()[order].tobytes()], "matrix": [matrix.tobytes()]}
        if limits:
            lists = table["least"].to_pylist()
            columns["limits"] = [[lists[k] for k in order]]
        return pa.table(columns)

    schema = "block long, rows long, keys binary, ids binary, labels binary, matrix binary" + (", limits array<array<long>>" if limits else "")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(n / size)))))
    packed = cut_lineage(placed.groupBy("block").applyInArrow(_typed(pack, schema), schema))
    return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in packed.columns))


def _typed(pack: Callable[[pa.Table], pa.Table], schema: str) -> Callable[[pa.Table], pa.Table]:
    types = {"long": pa.int64(), "binary": pa.binary(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    wanted = pa.schema([(n, types[t]) for n, t in (c.strip().split(" ") for c in schema.split(", "))])
    return lambda table: pack(table).cast(wanted)


def _pairs(anchors: DataFrame, n_anchors: int, vectors: DataFrame, n_vectors: int) -> DataFrame:
    """Every block of anchors beside every block of vectors, each pair by itself under a key of its own."""
    a_count, v_count = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n_vectors / BLOCK))
    parts = min(a_count * v_count, 100_000)
    left = anchors.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(v_count - 1)))).withColumn("v_block", F.col("v_block").cast("long"))
    right = vectors.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(a_count - 1)))).withColumn("a_block", F.col("a_block").cast("long"))
    keys = ["a_block", "v_block"]
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys)


def _unpacked(batch: pa.RecordBatch, row: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, ids, labels, matrix = (np.frombuffer(batch.column(f"{name}_{c}")[row].as_buffer(), np.int64) for c in ("keys", "ids", "labels", "matrix"))
    return keys, ids, labels, matrix.reshape(len(keys), -1)


def _scored(pairs: DataFrame, primes: list[int], select: Callable, schema: str) -> DataFrame:
    """What ``select`` picks of the scores of each pair of blocks."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, v = _unpacked(batch, row, "a"), _unpacked(batch, row, "v")
                wide = max(a[3].shape[1], v[3].shape[1])
                left, right = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a[3], v[3]))
                limits = batch.column("a_limits")[row].as_py() if "a_limits" in batch.schema.names else None
                for start in range(0, len(left), TOGETHER):
                    part = slice(start, start + TOGETHER)
                    scores = exact_scores(left[part], right, primes)
                    same = a[2][part, None] == v[2][None, :]
                    picked = select(scores, same, a[0][part], a[1][part], v[0], v[1], limits and limits[part])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=x == NO_ID if n in ("anchor", "id") else None) for n, x in zip(names, picked)], names)

    return pairs.mapInArrow(run, schema)


def _positives(scores, same, akeys, aids, vkeys, vids, limits):
    wanted = same & (akeys[:, None] != vkeys[None, :])
    r, c = _joined(first_columns(scores, wanted, POSITIVES))
    return akeys[r], aids[r], vkeys[c], vids[c], scores[r, c]


def _joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, c in found:
        rows.append(r)
        columns.append(c)
    return np.concatenate(rows), np.concatenate(columns)


def _negatives(low: int, high: int, k: int) -> Callable:
    def select(scores, same, akeys, aids, vkeys, vids, limits):
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for place in range(max((len(x) for x in limits), default=0)):
            has = np.array([len(x) > place for x in limits])
            positive = np.array([x[place] if len(x) > place else 0 for x in limits], np.int64)
            wanted = ~same & has[:, None] & (low * positive[:, None] <= 100 * scores) & (100 * scores <= high * positive[:, None])
            r, c = _joined(first_columns(scores, wanted, k))
            for to, x in zip(out, (akeys[r], aids[r], np.full(len(r), place + 1), vkeys[c], vids[c], scores[r, c])):
                to.append(x)
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]

    return select


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", vec: str = "embedding", label: str | Column = "label", scale: int = SCALE, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    Components become ``floor(scale * x)`` and a score is an exact integer inner product; shorter vectors are filled up with zeros.
    An anchor's positives are its best ``POSITIVES`` other rows of its label; the negatives of a positive are the best
    ``negatives`` rows of another label with a score of ``low`` to ``high`` hundredths of the positive's. Higher scores come first,
    equal ones by smaller id.

    Rows without a label, a vector or a component, or with a component that is not finite, take no part. Rows are told apart by
    a number of their own: rows that repeat an id, the anchor's too, are other rows, and a missing id comes last among equal
    scores. An empty table, or one without anchors, gives no rows; other columns are not read. Scores that may exceed
    ``LARGEST`` raise an error that names it.

    Anchors and rows are packed into blocks, every pair of blocks is a task's work of bounded size, and it returns a few rows per
    anchor: first the best positives, then, with their scores as windows, the best negatives.
    """
    in_small_batches(rows.sparkSession)
    named = label if isinstance(label, Column) else F.col(label)
    whole = keyed(rows, id, F.col(id).cast("long").alias("id"), named.alias("name"), quantised(F.col(vec), scale).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = cut_lineage(whole.where("name IS NOT NULL AND q IS NOT NULL").select("key", "id", F.xxhash64(F.col("name").cast("string")).alias("label"), "q", "anchor"))
    norm = F.aggregate("q", F.lit(0.0), lambda total, v: total + v.cast("double") * v)
    n, n_anchors, largest = taken.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(norm)).first()
    if largest and largest * 1.001 > LARGEST:
        raise ValueError(f"scores may reach {largest:.3g}; the largest that can be compared exactly is {LARGEST}")
    # no score exceeds the largest squared length
    primes = primes_for(int((largest or 0) * 1.001) + 1)
    vectors = _blocks(taken.select("key", "id", "label", "q"), n, BLOCK, "v")
    asked = taken.where("anchor").select("key", "id", "label", "q")
    pairs = _pairs(_blocks(asked, n_anchors, ANCHORS, "a"), n_anchors, vectors, n)
    schema = "akey long, anchor long, key long, id long, score long"
    positives = cut_lineage(_best(_scored(pairs, primes, _positives, schema), ["akey"], POSITIVES))
    # at most POSITIVES scores per anchor, in order of rank
    limits = positives.groupBy("akey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("least"))
    asked = asked.join(limits.withColumnRenamed("akey", "key"), "key")
    pairs = _pairs(_blocks(asked, n_anchors, ANCHORS, "a"), n_anchors, vectors, n)
    schema = "akey long, anchor long, place long, key long, id long, score long"
    found = _best(_scored(pairs, primes, _negatives(low, high, negatives), schema), ["akey", "place"], negatives)
    matched = found.join(positives.select("akey", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["akey", "place"])
    return matched.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
