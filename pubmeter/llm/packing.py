"""Packing: the corpus as one stream of tokens, cut into windows of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import in_small_batches, texts, worker_state
from pubmeter.llm.tokenizing import WordPieces
from pubmeter.session import cut_lineage

LENGTH = 2048
END = 1
# Partitions whose totals are summed by one task of the second level.
GROUP = 1024


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """``id, start, length, ids, doc_tokens, sequence_id, offset``: one row per piece.

    A document's tokens and then ``end`` follow those of the document before it, in the order of the input's partitions and
    rows. Pass one tokenizes each partition, writes the ids with their place in the partition, and adds up the partition's
    total; the prefix sums of the totals (one row per partition, so small enough to send to every task: the driver holds more
    for each task anyway) give each document's place in the stream. Pass two cuts the documents at the multiples of
    ``length``: a document across a boundary gives one record on each side. Only the last sequence is not full.

    ``ids`` holds unsigned 32-bit little-endian ids, ``start`` counts the document's ids before the piece, ``offset`` is the
    place in the sequence. A missing or empty text is the single id ``end``; repeated rows are packed once each; a missing id
    stays missing; an empty table has no pieces. Other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    source = texts(docs, id, text).toDF("id", "text")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_state(f"pieces {tokenizer}", lambda: WordPieces(tokenizer, "<u2"))
        part, place = TaskContext.get().partitionId(), 0
        last = np.array([end], "<u2").tobytes()
        for batch in batches:
            ids = [pieces.encode(t) + last for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) // 2 for x in ids], np.int64)
            places = place + np.cumsum(counts) - counts
            place += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(places), pa.array(counts), pa.array(ids, pa.binary())],
                ["id", "part", "place", "n", "ids"],
            )

    kind = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("part", "place", "n")), T.StructField("ids", T.BinaryType())])
    written = cut_lineage(source.mapInArrow(tokenize, kind))
    placed = written.join(F.broadcast(_offsets(written)), "part").select("id", (F.col("place") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = (batch.column(k).to_numpy() for k in (1, 2))
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(at)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + number
            start = np.maximum(sequence * length, at[row]) - at[row]
            stop = np.minimum((sequence + 1) * length, at[row] + n[row]) - at[row]
            whole = batch.column(3)
            ids = [np.frombuffer(whole[int(r)].as_buffer(), "<u2")[a:b].astype("<u4").tobytes() for r, a, b in zip(row, start, stop)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (start, stop - start)), pa.array(ids, pa.binary()), *(pa.array(x) for x in (n[row], sequence, at[row] + start - sequence * length))],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    out = T.StructType([T.StructField(id, kind["id"].dataType), *long[:2], T.StructField("ids", T.BinaryType()), *long[2:]])
    return placed.mapInArrow(cut, out)


def _offsets(written: DataFrame) -> DataFrame:
    """``part, before``: the tokens of all partitions before each; prefix sums within groups of partitions and over groups."""
    totals = written.groupBy("part").agg(F.sum("n").alias("total")).withColumn("group", F.floor(F.col("part") / GROUP))
    groups = totals.groupBy("group").agg(F.sum("total").alias("of_group"))
    below = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("group", F.coalesce(F.sum("of_group").over(below(Window.orderBy("group"))), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("total").over(below(Window.partitionBy("group").orderBy("part"))), F.lit(0))
    return totals.select("part", "group", inner.alias("inner")).join(starts, "group").select("part", (F.col("inner") + F.col("start")).alias("before"))
