"""Quality rules: fixed counts, and a hashed n-gram logistic regression learned from labelled rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import in_small_batches, texts
from pubmeter.llm.labelled import isotonic, training_ids
from pubmeter.session import cut_lineage

# Labelled rows that the model is fitted on at most; two tenths of them calibrate.
TRAINING_ROWS = 8_000
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
# Families of n-grams, each with buckets of its own: characters (bytes) by 3 and 4, words by 1 and 2.
FAMILIES = 4
KEEP = 0.5
# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
# Bytes whose n-grams are hashed together; longer texts are read in blocks of as many, with the same n-grams.
BLOCK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SYMBOL_BYTES = bytes(SYMBOLS)


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n > WINDOW and len(set(words)) < n:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = bytearray(n)
            for k, w in enumerate(windows):
                if times[w] > 1:
                    covered[k : k + WINDOW] = b"\1" * WINDOW
            repeated = sum(covered)
    return n, len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOL_BYTES)), len(lines) - len(set(lines)), repeated


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + family * BUCKETS


def ngram_buckets(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text, bucket`` of all n-grams of the texts, family by family. Texts are parted by a byte that no UTF-8 text has."""
    raw = np.frombuffer(b"\xff".join(data) + b"\xff", np.uint8)
    sizes = np.array([len(x) + 1 for x in data])
    owner = np.repeat(np.arange(len(data)), sizes)
    low = raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
    wide = low.astype(np.uint64)
    for family, size in enumerate((3, 4)):
        h = wide[: len(wide) - size + 1].copy()
        for k in range(1, size):
            h = (h << np.uint64(8)) | wide[k : len(wide) - size + 1 + k]
        own = owner[: len(h)]
        inside = own == owner[size - 1 :]
        yield own[inside], _bucket(h[inside], family)
    space = IS_SPACE[raw] | (raw == 255)
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(first):
        return
    start = np.zeros(len(raw), np.int64)
    start[first] = first
    start = np.maximum.accumulate(start)
    value = np.where(space, np.uint64(0), (wide + np.uint64(1)) * POWERS[(np.arange(len(raw)) - start) & 63])
    words = np.add.reduceat(value, first)
    own = owner[first]
    yield own, _bucket(words, 2)
    pair = words[:-1] * np.uint64(31) + words[1:]
    inside = own[1:] == own[:-1]
    yield own[:-1][inside], _bucket(pair[inside], 3)


def _lowered(raw: bytes | np.ndarray) -> np.ndarray:
    """Bytes as 64-bit numbers, A-Z in lower case."""
    part = np.frombuffer(raw, np.uint8)
    return (part | ((part >= 65) & (part <= 90)).astype(np.uint8) << 5).astype(np.uint64)


def long_ngrams(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """``family, bucket`` of all n-grams of one long text, read in blocks: the same ones as of the text as a whole.

    Each n-gram of bytes belongs to the block in which it starts. A word that a block cuts goes on in the next one with the sum
    of its hash so far, and the last word waits for the pair that it begins.
    """
    closed = raw + b"\xff"
    for family, size in enumerate((3, 4)):
        for k in range(0, len(closed) - size + 1, BLOCK):
            wide = _lowered(closed[k : k + BLOCK + size - 1])
            h = wide[: len(wide) - size + 1].copy()
            for j in range(1, size):
                h = (h << np.uint64(8)) | wide[j : len(wide) - size + 1 + j]
            yield family, _bucket(h, family)
    carried, length, before = np.zeros(1, np.uint64), 0, np.zeros(0, np.uint64)
    for k in range(0, len(raw), BLOCK):
        part = np.frombuffer(raw[k : k + BLOCK], np.uint8)
        low, space = _lowered(part), IS_SPACE[part]
        # an open word goes on at the first byte, be it a blank that ends it
        first = np.flatnonzero(~space & np.append(length == 0, space[:-1]))
        first = np.append(0, first) if length else first
        if not len(first):
            continue
        start = np.zeros(len(part), np.int64)
        start[first] = first
        start = np.maximum.accumulate(start)
        offset = np.where(start == 0, length, 0) if length else 0
        value = np.where(space, np.uint64(0), (low + np.uint64(1)) * POWERS[(np.arange(len(part)) - start + offset) & 63])
        words = np.add.reduceat(value, first)
        if length:
            words[:1] += carried
        size = len(part) - int(first[-1]) + (length if len(first) == 1 and length else 0)
        ends = bool(space[-1])
        carried, length = words[-1:], 0 if ends else size
        done = words if ends else words[:-1]
        yield 2, _bucket(done, 2)
        chain = np.concatenate([before, done])
        yield 3, _bucket(chain[:-1] * np.uint64(31) + chain[1:], 3)
        before = chain[-1:]
    if length:
        yield 2, _bucket(carried, 2)
        yield 3, _bucket(before * np.uint64(31) + carried[: len(before)], 3)


def _blocks(data: list[bytes]) -> Iterator[list[int]]:
    """Places of texts of at most BLOCK bytes, in groups of about as many."""
    held, size = [], 0
    for k, x in enumerate(data):
        if len(x) > BLOCK:
            continue
        if held and size + len(x) > BLOCK:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(x) + 1
    if held:
        yield held


def logits(raw: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Linear score of each text: in each family the mean weight of its n-grams."""
    total, number = np.zeros((FAMILIES, len(raw))), np.zeros((FAMILIES, len(raw)))
    for held in _blocks(raw):
        at = np.array(held)
        for family, (own, bucket) in enumerate(ngram_buckets([raw[k] for k in held])):
            total[family] += np.bincount(at[own], weights[bucket], len(raw))
            number[family] += np.bincount(at[own], minlength=len(raw))
    for k, x in enumerate(raw):
        if len(x) > BLOCK:
            for family, bucket in long_ngrams(x):
                total[family, k] += weights[bucket].sum()
                number[family, k] += len(bucket)
    return (total / np.maximum(number, 1)).sum(axis=0) + bias


def vector(raw: bytes) -> SparseVector:
    """Shares of the buckets within each family: what ``logits`` weighs."""
    out = np.zeros(FAMILIES * BUCKETS)
    found = long_ngrams(raw) if len(raw) > BLOCK else enumerate(b for _, b in ngram_buckets([raw]))
    for _, bucket in found:
        out += np.bincount(bucket, minlength=len(out))
    shares = out.reshape(FAMILIES, BUCKETS)
    shares = (shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)).ravel()
    used = np.flatnonzero(shares)
    return Vectors.sparse(len(shares), used, shares[used])


# Shares are small numbers; scaled up, the penalty of the fit acts alike on rare and common buckets.
SCALE = 100.0


@dataclass(frozen=True)
class Quality:
    """A fitted model as plain values."""

    weights: np.ndarray
    bias: float
    points: tuple[np.ndarray, np.ndarray] | None

    def probabilities(self, raw: list[bytes]) -> np.ndarray:
        score = logits(raw, self.weights, self.bias)
        if self.points is None:
            return 1.0 / (1.0 + np.exp(-score))
        return np.clip(np.interp(score, *self.points), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Quality:
    """A model from at most ``rows`` labelled texts; without labels of both classes every text gets their share of label 1."""
    in_small_batches(docs.sparkSession)
    # bounded: at most ``rows`` ids
    train = cut_lineage(texts(docs, id, text).toDF("id", "text").join(F.broadcast(training_ids(labels, id, label, rows)), "id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector((t or "").encode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.indices for v in found], pa.list_(pa.int32())), pa.array([v.values * SCALE for v in found], pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                ["at", "share", "label", "fold"],
            )

    size = FAMILIES * BUCKETS
    sparse = train.select("text", "label", "fold").mapInArrow(extract, "at array<int>, share array<double>, label double, fold long")
    as_vector = F.udf(lambda at, share: Vectors.sparse(size, at, share), VectorUDT())
    ready = cut_lineage(sparse.repartition(6).select(as_vector("at", "share").alias("features"), "label", "fold"))
    fitted = ready.where("fold < 8")
    shares = fitted.groupBy("label").count().collect()
    if len(shares) < 2:
        yes = float(shares[0]["label"]) if shares else 1.0
        return Quality(np.zeros(size), 20.0 * (2 * yes - 1), None)
    model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(fitted)
    weights, bias = np.array(model.coefficients.toArray()) * SCALE, float(model.intercept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = logits([(t or "").encode() for t in batch.column(0).to_pylist()], weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s)], ["label", "score"])

    held = train.where("fold >= 8")
    enough = held.select("label").distinct().count() == 2
    return Quality(weights, bias, isotonic((held if enough else train).select("text", "label").mapInArrow(score, "label double, score double")))


def judge(docs: DataFrame, model: Quality, id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept``: one row per row.

    Words are runs without ASCII white space. ``base_failed`` holds for fewer than ten words or where more than a fifth of
    the words lie in five-word windows that the text has twice; ``kept`` needs a passed base and a calibrated probability
    (``quality``) of at least ``keep``. A missing text counts as empty and fails. Repeated rows and missing ids are rows of
    their own, an empty table gives none, other columns are ignored.
    """
    in_small_batches(docs.sparkSession)
    source = texts(docs, id, text).toDF("id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).to_pylist()
            raw = [t.encode() for t in whole]
            counts = np.array([base_counts(t, x) for t, x in zip(whole, raw)], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEATED_PERCENT * counts[:, 0])
            p = model.probabilities(raw) if raw else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))], ["id", *names, "base_failed", "quality", "kept"]
            )

    kind = [T.StructField(id, source.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in names)]
    kind += [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return source.mapInArrow(run, T.StructType(kind))
