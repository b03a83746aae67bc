"""Removal of long repeated byte strings by sorting sampled suffixes and inducing the rest from them.

The suffix array of all texts is never written out. As in induced sorting, a sample of the suffixes is chosen by local
minima of the text itself, so that equal strings have equal samples; the sampled suffixes are grouped and sorted through
Spark's disk-backed shuffle; and what holds for the suffixes between two samples is induced from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import in_small_batches, keyed
from pubmeter.session import cut_lineage

LENGTH = 200
# Bytes at a sampled position by which suffixes are first told apart; a power of two.
HEAD = 64
# Bytes that are looked at together in one task, and place bits beside the hash: blocks are shorter than 2**PLACE.
BLOCK = 1 << 20
PLACE = 22
# Different surroundings of one head that a single task compares; beyond it, windows are dealt out by their own hash.
TOGETHER = 4096
# Windows that are compared in the map task before the rest is dealt out.
LOCAL = 1 << 18
GAP = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
TWIST = np.uint64(0xC2B2AE3D27D4EB4F)
CODES = np.random.default_rng(20240229).integers(0, 2**64, 257, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * TWIST
    x += right
    return _mixed(x)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the HEAD and of the 2 * HEAD bytes from each position on, by doubling."""
    h, wide = CODES[codes], 1
    while wide < HEAD:
        h = _joined(h[:-wide], h[wide:])
        wide *= 2
    return h, _joined(h[:-wide], h[wide:])


def _joined_texts(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with a gap behind each that equals nothing, and where each text starts."""
    sizes = np.array([len(x) + length for x in data], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.full(int(sizes.sum()) + 2 * HEAD, GAP, np.uint16)
    for x, s in zip(data, starts):
        codes[s : s + len(x)] = np.frombuffer(x, np.uint8)
    return codes, starts


def samples(data: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``text, place, low, high, head, around`` of the sampled positions of the texts.

    The sample of a window (``length`` bytes that start at one position) is the place in it where the hash of the next HEAD bytes
    is least, the leftmost of equals. So equal windows have their sample at the same distance and with the same head.
    ``low`` to ``high`` are the starts of the windows that share a sample; ``around`` hashes all bytes of these windows and how
    they lie around the sample.
    """
    codes, starts = _joined_texts(data, length)
    head, double = _hashes(codes)
    low_bits = np.uint64((1 << PLACE) - 1)
    best = (head & ~low_bits) | np.arange(len(head), dtype=np.uint64)
    reach, wide = length - HEAD + 1, 1
    while 2 * wide <= reach:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if reach > wide:
        best = np.minimum(best[: len(best) - (reach - wide)], best[reach - wide :])
    sizes = np.array([max(0, len(x) - length + 1) for x in data], np.int64)
    text = np.repeat(np.arange(len(data)), sizes)
    window = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[text]
    place = (best[window] & low_bits).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text))[: len(first)] - 1
    low, high, place, text = window[first], window[last], place[first], text[first]
    size = high - low + length
    around = _joined(_joined(_joined(double[low], double[low + (size - 2 * HEAD) // 2]), double[low + size - 2 * HEAD]), ((place - low) * 1024 + (high - low)).astype(np.uint64))
    base = starts[text]
    return text, place - base, low - base, high - base, head[place].view(np.int64), around.view(np.int64)


def window_hashes(data: list[bytes], lead: np.ndarray, head: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, window, hash`` of each window of each stretch of bytes; ``lead`` is the distance from its start to the sample."""
    codes, starts = _joined_texts(data, 0)
    double = _hashes(codes)[1]
    sizes = np.array([len(x) - length + 1 for x in data], np.int64)
    row = np.repeat(np.arange(len(data)), sizes)
    window = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[row] + window
    own = _joined(double[at], double[at + length - 2 * HEAD])
    own = _joined(own, head.view(np.uint64)[row])
    return row, window, _joined(own, (lead[row] - window).astype(np.uint64)).view(np.int64)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept``: one row per row.

    Every byte is removed that a string of ``length`` bytes covers which starts at another place too, in any text or the
    same one; strings never cross texts and are judged on the input. ``spans`` are the maximal removed runs as
    ``(start, stop)`` in bytes, ``kept`` the other bytes. Limits: ``length`` from 130 to 255.

    1. Map tasks sample each text (``samples``), about one position in seventy: head, surroundings, windows it speaks for.
    2. Heads that occur once settle all windows of their sample: no repeat. Heads are counted with map-side sums.
    3. Where head and surroundings occur twice, all windows of these samples are repeats; copies in any number end here.
    4. What is left are the ends of repeats: samples with the head but not the surroundings of another. Their bytes are
       fetched, sorted by head, and their windows compared within one task, or, beyond ``together`` different surroundings of
       one head, window by window: first in each map task, then one row for each of its windows over all tasks.
    5. The repeated windows of each text are merged to spans.

    Strings count as equal when their hashes (128 bits of head and window together) are. A missing text counts as empty: no
    bytes, nothing removed. Rows that repeat an id or have none are rows of their own, so copies remove each other. An empty
    table gives no rows; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType
    whole_texts = keyed(docs, id, F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, offsets, data in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                row, place, low, high, head, around = samples(data, length)
                at = offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row]), *(pa.array((x + at)) for x in (low, high, place)), pa.array(head), pa.array(around)],
                    ["key", "low", "high", "place", "head", "around"],
                )

    sampled = cut_lineage(whole_texts.select("key", "text").mapInArrow(sample, "key long, low long, high long, place long, head long, around long"))
    heads = cut_lineage(sampled.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"))
    shared = cut_lineage(sampled.join(heads, "head"))
    classes = shared.groupBy("head", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "low")).alias("first"))
    classes = cut_lineage(classes)
    kinds = classes.groupBy("head").agg(F.count(F.lit(1)).alias("kinds"))
    classes = cut_lineage(classes.join(kinds, "head"))
    told = cut_lineage(shared.join(classes, ["head", "around"]))
    settled = told.where("n > 1").select("key", "low", "high")
    wanted = told.where("kinds > 1 AND (n = 1 OR (first.key = key AND first.low = low))")
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("low", "high", "place", "head", "n", "kinds")).alias("samples"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t, found in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("samples").to_pylist()):
                whole = t.encode()
                column = lambda name, found=found: pa.array([x[name] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found), pa.int64()), column("low"), pa.array([x["place"] - x["low"] for x in found], pa.int64()), column("head"), column("n"), column("kinds"),
                     pa.array([whole[x["low"] : x["high"] + length] for x in found], pa.binary())],
                    ["key", "low", "lead", "head", "n", "kinds", "bytes"],
                )

    ends = cut_lineage(whole_texts.select("key", "text").join(per_text, "key").mapInArrow(fetch, "key long, low long, lead long, head long, n long, kinds long, bytes binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_heads(batches):
            key, low, lead, head, n = (table.column(c).to_numpy() for c in ("key", "low", "lead", "head", "n"))
            row, window, own = window_hashes(table.column("bytes").to_pylist(), lead, head, length)
            of = head[row]
            order = np.lexsort((own, of))
            same = (own[order][1:] == own[order][:-1]) & (of[order][1:] == of[order][:-1])
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            yield _runs(key, low, row, window, twice & (n[row] == 1))

    together_rows = ends.where(F.col("kinds") <= together).repartition("head").sortWithinPartitions("head")
    near = together_rows.mapInArrow(compare, "key long, low long, high long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, LOCAL // length):
            key, low, lead, head, n = (table.column(c).to_numpy() for c in ("key", "low", "lead", "head", "n"))
            row, window, own = window_hashes(table.column("bytes").to_pylist(), lead, head, length)
            of = head[row]
            order = np.lexsort((own, of))
            new = np.append(True, (own[order][1:] != own[order][:-1]) | (of[order][1:] != of[order][:-1]))
            size = np.diff(np.append(np.flatnonzero(new), len(own)))
            twice = np.zeros(len(own), bool)
            twice[order] = np.repeat(size > 1, size)
            # what repeats here is settled; of each window one row goes on, with the number of its places
            yield _dealt(_runs(key, low, row, window, twice & (n[row] == 1)), None, None, None)
            first = order[new]
            at = low[row[first]] + window[first]
            known = (size > 1) | (n[row[first]] > 1)
            yield _dealt(pa.RecordBatch.from_arrays([pa.array(key[row[first]]), pa.array(at), pa.array(at)], ["key", "low", "high"]), of[first], own[first], known)

    kind_of_row = "key long, low long, high long, head long, window long, known boolean"
    spread = cut_lineage(ends.where(F.col("kinds") > together).mapInArrow(windows, kind_of_row))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            own, of = table.column("window").to_numpy(), table.column("head").to_numpy()
            known = table.column("known").to_numpy(zero_copy_only=False)
            equal = (own[1:] == own[:-1]) & (of[1:] == of[:-1])
            met = np.append(False, equal) | np.append(equal, False)
            # the last row waits for its right neighbour, and remembers its left one
            wanted = met & ~known
            wanted[-1] = False
            yield table.select(["key", "low", "high"]).filter(pa.array(wanted))
            left = bool(equal[-1]) if len(equal) else False
            held = table.slice(len(own) - 1)
            if left and not known[-1]:
                yield held.select(["key", "low", "high"])
                held = pa.RecordBatch.from_arrays([*held.columns[:5], pa.array([True])], held.schema.names)

    sorted_windows = spread.where("window IS NOT NULL").repartition("head", "window").sortWithinPartitions("head", "window")
    far = spread.where("window IS NULL").select("key", "low", "high").unionByName(sorted_windows.mapInArrow(neighbours, "key long, low long, high long"))

    runs = settled.unionByName(near).unionByName(far).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    joined = whole_texts.join(runs, "key", "left").select("id", "text", "runs")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            runs = batch.column("runs")
            for k, t in enumerate(batch.column("text").to_pylist()):
                whole = t.encode()
                found = merged(runs[k], length)
                place, left = 0, []
                for a, b in found:
                    left.append(whole[place:a])
                    place = b
                left.append(whole[place:])
                kept.append(b"".join(left))
                n_bytes.append(len(whole))
                n_removed.append(len(whole) - len(kept[-1]))
                spans.append([{"start": a, "stop": b} for a, b in found])
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    return joined.mapInArrow(strip, T.StructType([T.StructField(id, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]))


def merged(runs: pa.ListScalar, length: int) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent byte spans that the windows cover."""
    if not runs.is_valid or not len(runs):
        return []
    values = runs.values
    low, high = values.field("low").to_numpy(), values.field("high").to_numpy() + length
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    return list(zip(low[new].tolist(), high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)].tolist()))


def _blocks(keys: list[int], whole: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in blocks of bounded size; a long one is cut so that each of its windows lies in one part."""
    own, offsets, data, size = [], [], [], 0
    for key, t in zip(keys, whole):
        x = t.encode()
        for start in range(0, len(x) - length + 1, BLOCK):
            part = x[start : start + BLOCK + length - 1]
            own.append(key)
            offsets.append(start)
            data.append(part)
            size += len(part) + length
            if size >= BLOCK:
                yield np.array(own, np.int64), np.array(offsets, np.int64), data
                own, offsets, data, size = [], [], [], 0
    if data:
        yield np.array(own, np.int64), np.array(offsets, np.int64), data


def _whole_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of bounded size that hold all rows of each of their heads."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.column("head").to_numpy()
        if held and sum(b.num_rows for b in held) >= 4096:
            last = held[-1].column("head")[-1].as_py()
            go_on = int(np.searchsorted(heads != last, True)) if heads[0] == last else 0
            go_on = len(heads) if heads[-1] == last else go_on
            if go_on:
                held.append(batch.slice(0, go_on))
            if go_on < len(heads):
                yield pa.Table.from_batches(held)
                held = [batch.slice(go_on)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches in tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _dealt(runs: pa.RecordBatch, head: np.ndarray | None, window: np.ndarray | None, known: np.ndarray | None) -> pa.RecordBatch:
    n = runs.num_rows
    extra = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())] if window is None else [pa.array(head), pa.array(window), pa.array(known)]
    return pa.RecordBatch.from_arrays([*runs.columns, *extra], ["key", "low", "high", "head", "window", "known"])


def _runs(key: np.ndarray, low: np.ndarray, row: np.ndarray, window: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring wanted windows."""
    row, window = row[wanted], window[wanted]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    at = low[row[first]]
    return pa.RecordBatch.from_arrays([pa.array(key[row[first]]), pa.array(at + window[first]), pa.array(at + window[last])], ["key", "low", "high"])
