"""Exact deduplication by composable polynomial fingerprints and a chunkwise comparison of equal ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import in_small_batches, keyed
from pubmeter.session import cut_lineage

SPACE = re.compile(r"[\x20\x09-\x0D]+")
# Bytes of a chunk that is hashed on its own: sums of bytes times powers below 2**31 stay exact in a double.
HASHED = 4096
# Bytes of a chunk that is compared at once.
COMPARED = 1 << 18
# Rows of one group that one task compares with the row that stays.
SPREAD = 2_000
# Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int, primes: tuple[int, int] = PRIMES) -> tuple[int, int]:
    """Fingerprint of two texts in a row from the fingerprints of both: the left one is shifted by the right one's length."""
    return tuple((a * pow(base, right_bytes, p) + b) % p for a, b, base, p in zip(left, right, BASES, primes))


def chunk_hashes(data: list[bytes], primes: tuple[int, int] = PRIMES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all chunks of all texts at once, and the number of chunks of each text. The first chunk is the short one."""
    powers = np.array([[pow(base, HASHED - 1 - i, p) for base, p in zip(BASES, primes)] for i in range(HASHED)], np.float64)
    counts = np.array([max(1, -(-len(x) // HASHED)) for x in data])
    hashes = []
    block: list[bytes] = []

    def flush() -> None:
        rows = np.frombuffer(b"".join(block), np.uint8).reshape(-1, HASHED)
        for k in range(0, len(rows), 512):
            hashes.append((rows[k : k + 512].astype(np.float64) @ powers).astype(np.int64) % np.array(primes))
        block.clear()

    size = 0
    for x, n in zip(data, counts):
        # zeros in front change no hash: the length is kept beside it
        block += [bytes(int(n) * HASHED - len(x)), x]
        size += int(n) * HASHED
        if size > 1 << 24:
            flush()
            size = 0
    if block:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros((0, 2), np.int64)), counts


def fingerprints(data: list[bytes], primes: tuple[int, int] = PRIMES) -> list[int]:
    """Whole-text fingerprints of 62 bits: chunk hashes combined from left to right, the texts of a batch in step."""
    hashes, counts = chunk_hashes(data, primes)
    first = np.cumsum(counts) - counts
    p = np.array(primes)
    shift = np.array([pow(base, HASHED, q) for base, q in zip(BASES, primes)])
    total = np.zeros((len(data), 2), np.int64)
    for k in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > k)
        total[own] = (total[own] * shift + hashes[first[own] + k]) % p
    return [int(a) << 31 | int(b) for a, b in total]


def normal(text: str) -> bytes:
    return SPACE.sub(" ", text).encode()


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES, spread: int = SPREAD) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``: one row per row, dropped ones too.

    Texts are equal when they are identical after each run of ASCII white space became one space. Every text is read once
    in the map tasks, hashed by chunks whose hashes combine by length-shifted arithmetic, and reduced to fingerprint, length
    and SHA-256. Rows of equal fingerprint and length are then compared with the smallest of them, chunk by chunk in
    sorted streams that hold one chunk in memory; large groups are spread over many tasks. Rows that differ from it in
    spite of the fingerprint form the next round's groups, so the result never rests on a hash.

    Of equal texts the row with the smallest id stays (a missing id sorts last; of rows that repeat an id and a text one
    stays). A missing text counts as empty. An empty table gives an empty result; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    # the number of a row tells apart rows that repeat an id
    source = keyed(docs, id, F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normal(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fingerprints(data, primes), pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data])],
                ["key", "id", "print", "n", "sha"],
            )

    long = T.LongType()
    fields = [("key", long), ("id", source.schema["id"].dataType), ("print", long), ("n", long), ("sha", T.StringType())]
    marked = source.mapInArrow(mark, T.StructType([T.StructField(n, t) for n, t in fields]))
    # rank puts a missing id last
    marks = cut_lineage(marked.withColumn("rank", F.struct(F.col("id").isNull().alias("none"), "id", "key")))
    group = ["print", "n", "round"]
    open_marks, done, turn = marks.withColumn("round", F.lit(0)), None, 0
    while True:
        groups = open_marks.groupBy(*group).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
        placed = cut_lineage(open_marks.join(groups, group))
        members = placed.where("size > 1").select("key", "print", "n", "first", "size")
        bad = cut_lineage(_compare(source, members, spread))
        if bad.isEmpty():
            settled = placed
            open_marks = None
        else:
            turn += 1
            open_marks = placed.join(bad, "key", "left_semi").select(*marks.columns, F.lit(turn).alias("round"))
            settled = placed.join(bad, "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if open_marks is None:
            break
    if turn:
        sizes = done.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
        done = done.drop("size").join(sizes, group)
    return done.select(
        F.col("id").alias(id), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("key") == F.col("first.key")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _compare(source: DataFrame, members: DataFrame, spread: int) -> DataFrame:
    """``key`` of the rows whose text is not that of the first row of their group."""
    # The first row goes to each of the tasks that share its group.
    tasks = F.floor((F.col("size") - 1) / spread) + 1
    wanted = members.select("key", "print", "n", (F.col("first.key") == F.col("key")).alias("is_first"), tasks.alias("tasks"))
    read = source.select("key", "text").join(wanted, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "print", "n", "is_first", "tasks", "chunk", "bytes"]
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list] = [[] for _ in names]
            size = 0
            for k, whole in enumerate(rows["text"]):
                x = normal(whole)
                for c in range(0, max(1, len(x)), COMPARED):
                    for column, value in zip(out, (*(rows[name][k] for name in names[:5]), c // COMPARED, x[c : c + COMPARED])):
                        column.append(value)
                    size += COMPARED
                    if size > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow)], names)
                        out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow)], names)

    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    kind = "key long, print long, n long, is_first boolean, tasks long, chunk long, bytes binary"
    chunks = read.select("key", "text", "print", "n", "is_first", "tasks").mapInArrow(cut, kind)
    share = F.when(F.col("is_first"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("tasks"))))
    dealt = chunks.withColumn("share", F.explode(share))
    streamed = dealt.repartition("print", "n", "share", "chunk").sortWithinPartitions("print", "n", "share", "chunk", F.desc("is_first"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            prints, ns, shares, numbers, data = (batch.column(c) for c in ("print", "n", "share", "chunk", "bytes"))
            wrong = []
            for k, now in enumerate(zip(prints.to_pylist(), ns.to_pylist(), shares.to_pylist(), numbers.to_pylist())):
                if now != place:
                    place, held = now, data[k].as_buffer().to_pybytes()
                elif data[k].as_buffer() != pa.py_buffer(held):
                    wrong.append(k)
            yield batch.select(["key"]).take(pa.array(wrong, pa.int64()))

    return streamed.mapInArrow(compare, "key long").distinct()
