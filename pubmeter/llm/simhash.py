"""SimHash near-duplicates: 64-bit fingerprints joined with themselves by walking pairs of nodes of a binary trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import components, in_small_batches, keyed, texts
from pubmeter.session import cut_lineage

BITS = 64
WORDS = 3
DISTANCE = 3
SEED = 42
# Fingerprints below one distributed node of the trie; larger nodes are cut into slices of about this size.
NODE = 1 << 14
# Shingles of one text that are hashed at once; node pairs, and pairs of fingerprints, that are looked at together.
BLOCK = 1 << 16
PAIRS = 1 << 16
LEAF = 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit b is 1 where more than half of the shingles' hashes have it; 0 for a text without words.

    A-Z become lower case, words are runs without ASCII white space, shingles keep their repeats, a shorter text is one
    shingle. The hash is XXH64 with seed 42 over the shingle's UTF-8 bytes.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        part = found[k : k + BLOCK + words - 1]
        if len(found) < words:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(words))))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted arrays ``a`` and ``b`` (or of ``a`` with itself) that differ in at most ``distance`` bits.

    A node of the trie is a range of a sorted array. Pairs of nodes go down one bit at a time, carry the bits in which
    their prefixes differ, and end where those exceed the budget. Small pairs of nodes are compared outright. Pairs wait
    on a stack in blocks, so memory stays bounded.
    """
    if not len(a) or not len(b):
        return
    root = [np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)]
    stack = [(BITS - 1, root)]
    while stack:
        bit, (a0, a1, b0, b1, diff) = stack.pop()
        area = (a1 - a0) * (b1 - b0)
        leaf = (area <= LEAF) | (bit < 0)
        yield from _compare(a, b, same, distance, *(x[leaf] for x in (a0, a1, b0, b1)))
        a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        # where the bit turns from 0 to 1 within each node's range
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << bit) & 0xFFFFFFFFFFFFFFFF)
        one = np.uint64(1 << bit)
        am = np.clip(np.searchsorted(a, (a[a0] & mask) | one), a0, a1)
        bm = np.clip(np.searchsorted(b, (b[b0] & mask) | one), b0, b1)
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        sides = [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None), (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~twin)]
        parts = []
        for x0, x1, y0, y1, d, wanted in sides:
            keep = (x1 > x0) & (y1 > y0) & (d <= distance)
            if wanted is not None:
                keep &= wanted
            parts.append([x[keep] for x in (x0, x1, y0, y1, d)])
        down = [np.concatenate(x) for x in zip(*parts)]
        for k in range(0, len(down[0]), PAIRS):
            stack.append((bit - 1, [x[k : k + PAIRS] for x in down]))


def _compare(a: np.ndarray, b: np.ndarray, same: bool, distance: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = b1 - b0
    area = (a1 - a0) * wide
    total = np.cumsum(area)
    start = 0
    while start < len(area):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + 8 * PAIRS)))
        size = area[start:stop]
        row = np.repeat(np.arange(start, stop), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a0[row] + k // wide[row], b0[row] + k % wide[row]
        near = np.bitwise_count(a[i] ^ b[j]) <= distance
        if same:
            near &= i < j
        yield i[near], j[near]
        start = stop


def forest(a: np.ndarray, b: np.ndarray, same: bool, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """``(value, root)`` of each value that is linked, with one root per connected group: never more rows than values."""
    values = a if same else np.concatenate([a, b])
    label = np.arange(len(values))
    for i, j in close_pairs(a, b, same, distance):
        j = j if same else j + len(a)
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, node: int = NODE) -> DataFrame:
    """``id, print, component_id``: one row per row, ``print`` the fingerprint as a signed 64-bit integer.

    Rows link where their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id that can be
    reached. Equal fingerprints are grouped first. The distinct ones form the trie: its nodes at a depth that leaves about
    ``node`` fingerprints below each are the units of distribution. Every node meets the nodes whose prefix lies within the
    budget, by a join on the prefix, and each pair of nodes is walked in one task, which returns a spanning forest of the
    links and not the links. Connected components of the forests give the groups.

    A missing text counts as empty, and all texts without words share fingerprint zero. Rows that repeat an id share no
    component for that alone; a missing id stays missing and never names a component. Empty tables and other columns are no
    special case.
    """
    rows = texts(docs, id, text).toDF("id", "text").withColumn("key", F.lit(0).cast("long"))
    return _grouped(rows, words, distance, node).select(F.col("id").alias(id), "print", "component_id")


def _grouped(rows: DataFrame, words: int, distance: int, node: int) -> DataFrame:
    """``key, id, print, component, component_id`` of the rows ``key, id, text``; ``component`` is a fingerprint of the group."""
    in_small_batches(rows.sparkSession)
    source = rows.select("key", "id", F.coalesce("text", F.lit("")).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["key", "id", "print"])

    marked = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", source.schema["id"].dataType), T.StructField("print", T.LongType())])
    marks = cut_lineage(source.mapInArrow(mark, marked))
    prints = cut_lineage(marks.groupBy("print").agg(F.min("id").alias("first")))
    groups = components(_links(prints.select("print"), distance, node))
    joined = prints.join(groups.withColumnRenamed("id", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut_lineage(joined.select("print", "component").join(smallest, "component").select("print", "component", "component_id"))
    return marks.join(named, "print").select("key", "id", "print", "component", "component_id")


def _links(prints: DataFrame, distance: int, node: int) -> DataFrame:
    """``a, b``: spanning forests of the close fingerprints, one for each pair of trie nodes within the budget."""
    depth = min(24, max(0, math.ceil(math.log2(max(1, prints.count()) / node))))
    prefix = F.shiftrightunsigned("print", BITS - depth) if depth else F.lit(0).cast("long")
    placed = prints.select("print", prefix.alias("node"))
    slices = placed.groupBy("node").agg((F.floor((F.count(F.lit(1)) - 1) / node) + 1).alias("slices"))
    sliced = placed.join(slices, "node").withColumn("slice", F.pmod(F.xxhash64("print"), F.col("slices")))
    nodes = cut_lineage(sliced.groupBy("node", "slice").agg(F.collect_list("print").alias("prints")))
    masks = [sum(1 << k for k in bits) for size in range(min(distance, depth) + 1) for bits in combinations(range(depth), size)]
    near = F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseXOR(F.col("node")))
    left = nodes.select(F.col("node").alias("a_node"), F.col("slice").alias("a_slice"), F.col("prints").alias("a"), F.explode(near).alias("node")).where("node >= a_node")
    pairs = left.join(nodes.withColumnRenamed("prints", "b"), "node").where("node > a_node OR slice >= a_slice")
    pairs = pairs.select("a", "b", ((F.col("node") == F.col("a_node")) & (F.col("slice") == F.col("a_slice"))).alias("same"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.sort(batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for c in (0, 1))
                values, roots = forest(a, b, batch.column(2)[k].as_py(), distance)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(roots.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(walk, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, node: int = NODE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id.

    Rows are told apart by a number of their own, so rows that repeat an id are judged each by its text; of those that share
    both id and group one stays. Rows without an id stay.
    """
    names = docs.columns
    rows = keyed(docs, id, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    found = _grouped(rows.select("key", F.col("row").getField(id).alias("id"), F.col("row").getField(text).alias("text")), words, distance, node)
    first = found.where("id = component_id").groupBy("component").agg(F.min("key").alias("key"))
    stay = cut_lineage(first.select("key").unionByName(found.where("id IS NULL").select("key")))
    # a merge join at every size, so what moves is in proportion to the input
    return rows.join(stay.hint("merge"), "key", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in names))
