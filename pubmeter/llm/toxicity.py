"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.llm.common import in_small_batches, texts
from pubmeter.llm.labelled import isotonic, remainder, training_ids
from pubmeter.session import cut_lineage

# Labelled rows that the model is fitted on at most.
TRAINING_ROWS = 20_000
# Parts of the labelled rows that lexicons and trees leave out in turn, so that each row is judged by what others taught.
PARTS = 5
# Rows' worth of the share of all labels in a step of the calibration.
SHRINK = 2.0
# Entries of the lexicon at most (it bounds what travels with the job), and how sure an entry must be: log odds, and texts it occurs in.
LEXICON = 2_000
# Characters of a word whose weight a worker keeps.
LONGEST_KEPT = 64
MIN_ODDS = 2.0
MIN_TEXTS = 3
REJECT = 0.3
TREES, DEPTH = 20, 4
# Insults and second-person words of the corpus's languages; the lexicon learns from the labels beyond them.
INSULTS = """idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting garbage ugly filthy
shut hate kill die freak creep pig rat vermin dumm dummkopf trottel abschaum arschloch schwachkopf crétin connard débile ordure
imbécile estúpido idiota basura imbécil escoria""".split()
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
NEAR = 5
LETTERS = re.compile(r"[^\W\d_]+")
DIGIT_LETTERS = str.maketrans("013457@$!", "oieastasi")
# A sign or digit between letters. What lies between has no letter, so no text is read twice.
MIXED = re.compile(r"[A-Za-z][0134579@$!*.\-][0134579@$!*]*(?=[A-Za-z])")
UPPER = bytes(range(65, 91))
LETTER_BYTES = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = b"!?"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = 16


def stems(word: str) -> list[str]:
    """What the lexicon may know of a word: itself, marked as whole, and its beginnings."""
    return [f"{word}|", *(word[:k] for k in PREFIXES if len(word) >= k)]


def plain(word: str) -> str:
    """Lower case, digits and signs that stand for letters replaced, anything else at the ends or inside dropped."""
    low = word.lower()
    if low.isalpha():
        return low
    if low.isdigit():
        return ""
    found = LETTERS.findall(low)
    if len(found) == 1 and low.strip(".,;:!?\"'()|*#$%&<>") == found[0]:
        return found[0]
    return "".join(LETTERS.findall(low.strip(".,;:!?\"'()|*#%&<>").translate(DIGIT_LETTERS)))


class Weights(dict):
    """Raw word -> weight of the strongest lexicon entry for it, 0 where there is none; second-person words are nan."""

    def __init__(self, lexicon: dict[str, float], kept: int = 100_000) -> None:
        super().__init__()
        self.lexicon, self.kept = lexicon, kept

    def __missing__(self, word: str) -> float:
        bare = plain(word)
        weight = math.nan if bare in SECOND_PERSON else max((self.lexicon.get(s, 0.0) for s in stems(bare)), default=0.0) if bare else 0.0
        if len(self) < self.kept and len(word) <= LONGEST_KEPT:
            self[word] = weight
        return weight


def features(text: str, weights: Weights) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    you = np.flatnonzero(np.isnan(w))
    hits = np.flatnonzero(w > 0)
    strong = np.flatnonzero(w > 4)
    if len(you) and len(hits):
        k = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.maximum(k - 1, 0)]), np.abs(hits - you[np.minimum(k, len(you) - 1)]))
        close = float((gap <= NEAR).sum())
    else:
        close = 0.0
    raw = text.encode()
    size = max(1, len(raw))
    count = lambda these: len(raw) - len(raw.translate(None, these))
    letters = max(1, count(LETTER_BYTES))
    mixed = len(MIXED.findall(text))
    top = np.sort(w[hits])[::-1][:3]
    top = np.append(top, np.zeros(3 - len(top)))
    return [
        float(len(hits)), len(hits) / n, float(w[hits].sum()), float(w[hits].sum()) / n, float(len(strong)), len(strong) / n,
        *top.tolist(), close, len(you) / n, count(UPPER) / letters, count(MARKS) / size, count(PUNCTUATION) / size, mixed / n, math.log1p(len(words)),
    ]


def learn_lexicons(train: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Words and beginnings of words that toxic texts hold far more often than others, at most ``size``, with their log odds.

    ``train`` has ``text``, ``label`` and ``part``. The k-th lexicon leaves out the rows of part k, the last one none. Texts are
    reduced to their distinct stems in the map tasks and counted by stem and part, once for all lexicons.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for t, y, part in zip(*(c.to_pylist() for c in batch.columns)):
                for s in {s for word in {plain(x) for x in set(t.split())} if word for s in stems(word)}:
                    seen.setdefault((s, part), [0, 0])[int(y > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int32()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0))], ["stem", "part", "yes", "no"])

    rows = {r["part"]: (r["yes"], r["n"] - r["yes"]) for r in train.groupBy("part").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n")).collect()}
    found = train.select("text", "label", F.col("part").cast("int").alias("part")).mapInArrow(distinct, "stem string, part int, yes long, no long")
    by_part = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(PARTS) for c in ("yes", "no")]
    counted = cut_lineage(found.groupBy("stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), *by_part).where(F.col("yes") >= MIN_TEXTS))
    out = []
    for k in range(PARTS + 1):
        less = lambda c: F.col(c) - F.col(f"{c}{k}") if k < PARTS else F.col(c)  # noqa: E731, B023
        yes, no = (sum(v[i] for part, v in rows.items() if part != k) + 1.0 for i in (0, 1))
        own = counted.select("stem", less("yes").alias("yes"), less("no").alias("no"))
        odds = F.log((F.col("yes") + 0.5) / yes) - F.log((F.col("no") + 0.5) / no)
        sure = own.where(F.col("yes") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
        best = sure.orderBy(F.desc(F.col("odds") * F.sqrt("yes")), "stem").limit(size).collect()
        out.append({f"{w}|": 5.0 for w in INSULTS} | {r["stem"]: float(r["odds"]) for r in best})
    return out


@dataclass(frozen=True)
class Toxicity:
    """A fitted model as plain values: it travels with the job and scores batches without the session."""

    lexicon: dict[str, float]
    trees: list
    base: float
    points: tuple[np.ndarray, np.ndarray] | None

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        weights = Weights(self.lexicon)

        def score(batch: list[str]) -> np.ndarray:
            if not self.trees:
                return np.full(len(batch), self.base)
            x = np.array([features(t, weights) for t in batch], np.float64).reshape(-1, FEATURES)
            raw = margin(self.trees, x)
            return raw if self.points is None else np.clip(np.interp(raw, *self.points), 0.0, 1.0)

        return score


def margin(trees: list, x: np.ndarray) -> np.ndarray:
    """Sum of the trees' weighted outputs, each tree walked by all rows together."""
    total = np.zeros(len(x))
    for weight, feature, threshold, left, right, value in trees:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            at = node[inner]
            go = x[inner, feature[at]] <= threshold[at]
            node[inner] = np.where(go, left[at], right[at])
        total += weight * value[node]
    return total


def _arrays(model) -> list:
    """The fitted trees as arrays of split feature (-1 at a leaf), threshold, children and value."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list] = []

        def visit(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, node.prediction()])
            if node.numDescendants() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = visit(node.leftChild())
                rows[at][3] = visit(node.rightChild())
            return at

        visit(tree._call_java("rootNode"))
        columns = list(zip(*rows))
        out.append((float(weight), np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4])))
    return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Toxicity:
    """A model from at most ``rows`` labelled texts whose remainder (``labelled.remainder``) is not 2.

    All of them teach every step, but none its own judgement: the features of a row come from a lexicon learned without its part,
    each half of the rows grows trees for the other half, and the calibration is fitted to what these say. Both halves' trees score a
    text together. With labels of one class only, every text gets the share of label 1.
    """
    in_small_batches(docs.sparkSession)
    ids = training_ids(labels.where(remainder(id) != 2), id, label, rows)
    # bounded: at most ``rows`` ids
    source = texts(docs, id, text).toDF("id", "text")
    train = cut_lineage(source.join(F.broadcast(ids), "id").withColumn("part", (F.col("fold") % PARTS).cast("int")).withColumn("half", (F.col("fold") >= 5).cast("int")))
    n, yes = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = float(yes / n) if n else 0.0
    lexicons = learn_lexicons(train)
    if yes in (0, n):
        return Toxicity(lexicons[-1], [], base, None)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(lexicon) for lexicon in lexicons[:PARTS]]
        for batch in batches:
            x = [features(t, weights[part]) for t, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(3)], ["x", "label", "half"])

    dense = cut_lineage(train.select("text", "label", "part", "half").mapInArrow(extract, "x array<double>, label double, half int").repartition(4))
    grown = []
    for half in (0, 1):
        own = dense.where(F.col("half") != half).select("label", array_to_vector("x").alias("features"))
        mixed = own.select("label").distinct().count() == 2
        grown.append(_arrays(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(own)) if mixed else [])
    if not all(grown):
        # one half has a single class: the trees of all rows serve, and judge themselves
        every = dense.select("label", array_to_vector("x").alias("features"))
        grown = [_arrays(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(every))] * 2

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, FEATURES), batch.column(2).to_numpy()
            scores = np.where(half == 0, margin(grown[0], x), margin(grown[1], x))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores)], ["label", "score"])

    judged = cut_lineage(dense.select("x", "label", "half").mapInArrow(outputs, "label double, score double"))
    points = shrunk(isotonic(judged), judged, base)
    trees = [(weight / 2, *arrays) for weight, *arrays in [*grown[0], *grown[1]]]
    return Toxicity(lexicons[-1], trees, base, points)


def shrunk(points: tuple[np.ndarray, np.ndarray], judged: DataFrame, base: float) -> tuple[np.ndarray, np.ndarray]:
    """The calibration with each step drawn towards ``base`` as if SHRINK rows of it were added to those that support the step."""
    at, value = points
    # one score per row of the bounded sample
    scores = np.sort(judged.select("score").toArrow()["score"].to_numpy())
    supported = np.interp(scores, at, value)
    steps, counts = np.unique(np.round(supported, 9), return_counts=True)
    rows = counts[np.searchsorted(steps, np.round(value, 9)).clip(0, len(steps) - 1)]
    return at, np.maximum.accumulate((value * rows + base * SHRINK) / (rows + SHRINK))


def score_toxicity(docs: DataFrame, model: Toxicity, id: str = "doc_id", text: str = "text", reject: float = REJECT) -> DataFrame:
    """``id, held_out, score, predicted``, one row per row, from the whole text alone.

    ``score`` is the calibrated probability of label 1, ``predicted`` is 1 from ``reject`` on. A missing text counts as empty
    and is scored like any other. ``held_out`` marks the remainder that no label was learned from; it is false for a
    missing id. Repeated rows get equal scores, an empty table none.
    """
    in_small_batches(docs.sparkSession)
    source = docs.select(F.col(id).alias("id"), F.coalesce(remainder(id) == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model.scorer()
        for batch in batches:
            s = run(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= reject).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = T.StructType([T.StructField(id, source.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(score, kind)


def drop_toxic(docs: DataFrame, model: Toxicity, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``reject``."""
    in_small_batches(docs.sparkSession)
    names = [f.name for f in docs.schema.fields]
    at = names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model.scorer()
        for batch in batches:
            s = run([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < reject))

    return docs.mapInArrow(keep, docs.schema)
