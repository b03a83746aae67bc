"""Near-duplicates by SetSketch registers: bands of registers propose, a joint likelihood sifts, whole sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import components, in_small_batches, keyed, texts
from pubmeter.session import cut_lineage

WORDS = 3
# Two sets link if their intersection is at least this share of their union, in hundredths.
PERCENT = 85
# A pair at the similarity of 0.85 shares none of the bands with a chance of (1 - 0.85**5)**28 = 8e-8.
BANDS = 28
ROWS = 5
REGISTERS = BANDS * ROWS
# Registers count exponential steps of this base, down from A to A * BASE**-(LIMIT + 1): 16 bits each.
BASE = 1.001
A = 20.0
LIMIT = (1 << 16) - 2
SEED = 42
# Standard errors by which an estimate may fall short before a pair is not looked at.
ERRORS = 5
# Counters of shingles for the order of rarity: a table of a fixed 2 MB.
SLOTS = 1 << 19
# Shingles that are hashed, or put into registers, at once.
BLOCK = 1 << 14
_seeds = np.random.default_rng(SEED)
SHIFTS = _seeds.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
FACTORS = _seeds.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes (XXH64) of the word shingles of ``text``.

    A-Z become lower case, words are runs without ASCII white space; a text of fewer words is one shingle, one without words none.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    parts = []
    for k in range(0, max(1, len(found) - words + 1), BLOCK):
        part = found[k : k + BLOCK + words - 1]
        joined = [b" ".join(part)] if len(found) < words else map(b" ".join, zip(*(part[i:] for i in range(words))))
        parts.append(np.unique(np.fromiter((digest(s, SEED) for s in joined), np.uint64)))
    return np.unique(np.concatenate(parts))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the registers' hash functions over a set that isn't empty; minima of parts merge by minimum."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK // REGISTERS)
    for k in range(0, len(hashes), step):
        np.minimum(low, ((hashes[k : k + step, None] ^ SHIFTS) * FACTORS).min(axis=0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers: minima as exponential variables of rate A, in truncated steps of BASE. They merge by maximum."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of most likelihood of pairs of sets, given their registers (a row each) and their sizes.

    With shares u and v of the sizes in their sum, a register of the first set is the larger one with probability
    p(u - v J), of the second with p(v - u J), where p(x) = -log(1 - x (b - 1) / b) / log b. The likelihood of the numbers
    of registers that are larger, smaller and equal is concave in J, so halving its interval by thirds finds the maximum.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    probability = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = probability(u - v * j), probability(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-300))
        return more * log(p) + less * log(q) + same * log(1 - p - q)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        up = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def least_estimate(percent: int) -> float:
    """What the estimate of a pair at the limit falls below with a chance of under one in a million."""
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / REGISTERS) ** 0.5


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id``, one row per row; ``component_id`` is the smallest id that links reach.

    Rows link where their sets of distinct shingles have an intersection of at least ``percent`` hundredths of the union. Texts
    without words, missing ones among them, have an empty set and link with nothing. Rows are told apart by a number of their own: rows that
    repeat an id link by their texts alone; a missing id stays missing and names no component unless all of its rows lack one.
    An empty table gives no rows; other columns are not read.

    Rows of equal sets (by 128 bits of hash) are one set from here on. Bands of registers put sets into buckets. No bucket is ever
    paired with itself: its members meet the most central of them, the estimate sifts these pairs, whole sets decide,
    and linked sets become one component, so what moves is in proportion to the members. Members of buckets that still
    hold several components then meet across components by their rarest shingles, so many that sets which link must share one
    (prefix filter), and whole sets decide again. This last step misses no link at all.
    """
    in_small_batches(docs.sparkSession)
    rows = keyed(docs, id, F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = cut_lineage(_marks(rows, words))
    sets = marks.where("n > 0").groupBy("digest").agg(F.min("key").alias("set"), F.min("id").alias("first"))
    sets = cut_lineage(sets)
    held = cut_lineage(marks.join(sets.select(F.col("set").alias("key")), "key", "left_semi").select(F.col("key").alias("set"), "n", "registers"))
    roots = _components(held, rows.select(F.col("key").alias("set"), "text"), words, percent)
    joined = sets.join(roots, "set", "left").withColumn("component", F.coalesce("component", "set"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut_lineage(joined.select("digest", "component").join(smallest, "component").select("digest", "component_id"))
    found = marks.where("n > 0").join(named, "digest").select("id", "n", "component_id")
    alone = marks.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def _marks(rows: DataFrame, words: int) -> DataFrame:
    """``key, id, n, digest, registers`` of each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingles(text, words)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sketches.append(registers(minima(hashes)).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["key", "id", "n", "digest", "registers"])

    long, binary = T.LongType(), T.BinaryType()
    fields = [("key", long), ("id", rows.schema["id"].dataType), ("n", long), ("digest", binary), ("registers", binary)]
    return rows.mapInArrow(mark, T.StructType([T.StructField(n, t) for n, t in fields]))


def _components(held: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """``set, component`` for the sets that link with another."""
    bands = F.array(*(F.xxhash64(F.lit(b), F.expr(f"substring(registers, {2 * ROWS * b + 1}, {2 * ROWS})")) for b in range(BANDS)))
    placed = cut_lineage(held.select("set", "n", F.explode(bands).alias("bucket")))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_lineage(placed.join(sizes, "bucket").select("bucket", "set", "n", "size"))
    hashed = cut_lineage(_hashed(source.join(members.select("set").distinct(), "set"), words))
    # a set that meets many others in its buckets stands in the middle of its group: the most central member of a bucket meets all others
    central = members.groupBy("set").agg(F.sum("size").alias("met"))
    ranked = members.join(central, "set")
    chosen = ranked.groupBy("bucket").agg(F.max(F.struct("met", "set", "n")).alias("pivot")).select("bucket", F.col("pivot.set").alias("a"), F.col("pivot.n").alias("m"))
    pairs = members.join(chosen, "bucket").where((F.col("set") != F.col("a")) & _sizes_allow("n", "m", percent)).select("a", F.col("set").alias("b")).distinct()
    links = cut_lineage(_verified(cut_lineage(_likely(pairs, held, percent)), hashed, percent))
    rest = _unsettled(members, links).select("set", "n", "component").distinct()
    found = _verified(cut_lineage(_rare_pairs(cut_lineage(rest), hashed, percent)), hashed, percent)
    return components(links.unionByName(found)).select(F.col("id").alias("set"), "component")


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, with their components by ``links``, of the buckets that still hold several."""
    roots = components(links).select(F.col("id").alias("set"), "component")
    now = members.join(roots, "set", "left").withColumn("component", F.coalesce("component", "set"))
    now = cut_lineage(now.select("bucket", "set", "n", "component"))
    several = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return cut_lineage(now.join(several, "bucket"))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _hashed(source: DataFrame, words: int) -> DataFrame:
    """``set, hashes``: the sorted distinct 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["set", "hashes"])

    return source.select("set", "text").mapInArrow(run, "set long, hashes binary")


def _likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose registers make the similarity likely enough."""
    least = least_estimate(percent)
    side = lambda c: held.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = pa.array(estimate(x, y, n_a, n_b) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link by their whole sets."""
    side = lambda c: hashed.select(F.col("set").alias(c), F.col("hashes").alias(f"h_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64) for c in ("h_a", "h_b"))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _rare_pairs(rest: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of ``rest`` (``set, n, component``) of two components that may link, by shared rare shingles.

    Shingles are ordered by how many of these sets hold a shingle of the same counter. Two sets of x and y shingles that link have
    ``o = ceil(percent (x + y) / (100 + percent))`` in common, so they share one of the first ``x - o + 1`` and ``y - o + 1``.
    """
    spark = rest.sparkSession
    mine = cut_lineage(hashed.join(rest, "set").select("set", "n", "component", "hashes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount((np.frombuffer(value.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        for k in range(0, len(used), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(used[k : k + BLOCK]), pa.array(total[used[k : k + BLOCK]])], ["slot", "n"])

    counts = mine.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # at most SLOTS rows, whatever the input
    found = counts.toArrow()
    table = np.zeros(SLOTS, np.int32)
    table[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    shared = spark.sparkContext.broadcast(table)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, n, component, value in zip(*(batch.column(c) for c in ("set", "n", "component", "hashes"))):
                hashes = np.frombuffer(value.as_buffer(), np.uint64)
                size = len(hashes)
                order = np.lexsort((hashes, weight[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
                rare = hashes[order[: size - (percent * size + 99) // 100 + 1]]
                for to, x in zip(columns, (rare.view(np.int64), np.arange(len(rare)), *(np.full(len(rare), v.as_py()) for v in (key, n, component)))):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in columns], ["shingle", "place", "set", "n", "component"])

    first = cut_lineage(mine.mapInArrow(begin, "shingle long, place long, set long, n long, component long"))
    other = first.withColumnsRenamed({"place": "p", "set": "b", "n": "m", "component": "c"})
    overlap = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    within = (F.col("place") <= F.col("n") - overlap) & (F.col("p") <= F.col("m") - overlap)
    met = first.join(other, "shingle").where((F.col("set") < F.col("b")) & (F.col("component") != F.col("c")) & _sizes_allow("n", "m", percent) & within)
    return met.select(F.col("set").alias("a"), "b").distinct()
