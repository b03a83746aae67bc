"""Language of web pages: text likelihoods fused with declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.llm.common import in_small_batches
from pubmeter.llm.labelled import training_texts
from pubmeter.session import cut_lineage

# Labelled texts of each language that its likelihoods are fitted on at most.
TRAINING_ROWS = 1_000
BUCKET_BITS = 16
# Neighbouring letter triples share letters, so their evidence counts for less than its number.
TEMPER = 0.2
# Pages' worth of the wider prior in a narrower one: of all pages in a suffix, of the suffix in a host.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 5.0
DECLARED_WEIGHT = 1.0
BLOCK = 1 << 20
HIDDEN = re.compile(r"(?i)<(script|style)\b")
CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
HTML_TAG = re.compile(r"(?i)<html([^>]*)")
LANGUAGE = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})")


def page_text(html: str) -> str:
    """The words of a page: scripts, styles, comments and tags become blanks, entities their characters.

    One pass: what is not closed is a tag where a ``>`` follows, and text otherwise; a closing mark that was looked for in vain
    is not looked for again.
    """
    out, at, missing = [], 0, set()

    def after(mark: str, start: int) -> int:
        if mark in missing:
            return -1
        if mark in CLOSING:
            found = CLOSING[mark].search(html, start)
            end = found.end() if found else -1
        else:
            place = html.find(mark, start)
            end = place + len(mark) if place >= 0 else -1
        if end < 0:
            missing.add(mark)
        return end

    while True:
        start = html.find("<", at)
        if start < 0:
            out.append(html[at:])
            return entities.unescape("".join(out))
        out.append(html[at:start])
        hidden = HIDDEN.match(html, start)
        end = after(hidden[1].lower(), hidden.end()) if hidden else after("-->", start + 4) if html.startswith("<!--", start) else -1
        if end < 0:
            end = after(">", start + 1)
        out.append(" " if end >= 0 else "<")
        at = end if end >= 0 else start + 1


def declared_language(html: str) -> str | None:
    """The language that the first ``html`` tag with a ``lang`` declares, the last one there, in lower case."""
    for tag in HTML_TAG.finditer(html):
        found = LANGUAGE.findall(tag[1])
        if found:
            return found[-1].lower()
    return None


def triple_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte triples of a lower-cased text, in blocks."""
    raw = " ".join(text.lower().split()).encode()
    for k in range(0, max(1, len(raw) - 2), BLOCK):
        b = np.frombuffer(raw[k : k + BLOCK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            yield ((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Triples:
    """Log probabilities of the triple buckets: one row per language."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def log_likelihoods(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for buckets in triple_buckets(text):
            total += self.weights[:, buckets].sum(axis=1)
        return total * TEMPER


def fit(docs: DataFrame, text: str = "text", language: str = "lang", rows: int = TRAINING_ROWS) -> Triples:
    """Triple likelihoods of every labelled language, from at most ``rows`` texts of each, taken by hash.

    Missing texts and languages teach nothing.
    """
    in_small_batches(docs.sparkSession)
    sample = training_texts(docs, text, language, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = seen.setdefault(y, np.zeros(1 << BUCKET_BITS, np.int64))
                for buckets in triple_buckets(t):
                    own += np.bincount(buckets, minlength=len(own))
        for y, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([y] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], 1))], ["language", "bucket", "n"])

    # buckets times languages
    found = sample.mapInArrow(count, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(found.language.unique()))
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    for k, y in enumerate(languages):
        own = found[(found.language == y) & (found.bucket >= 0)]
        counts[k, own.bucket.to_numpy()] = own.n.to_numpy()
    return Triples(languages, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def identify(pages: DataFrame, model: Triples, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, language, probability, text_language, declared, host``: one row per page.

    Evidence is fused by Bayes' rule: the likelihood of the page's text, the likelihood of the language that its markup
    declares (how pages of each language, by their text, declare themselves), and a prior of its host. The host's prior is
    shrunk towards that of its address suffix, and that towards all pages', by the pages' text posteriors, in grouped sums;
    a page's own text is taken out of its priors, so it counts once. Sums are combined in the map tasks, and hosts meet pages
    in joins that adaptive execution splits, so one host may hold any share of the pages.

    A missing page counts as empty and rests on the other evidence, a missing or broken address on all pages' prior, a missing
    declaration on nothing. Repeated rows and ids are rows of their own. Ties go to the first language by name. Without a
    known language, language and probability are missing. An empty table gives no rows; other columns are ignored.
    """
    in_small_batches(pages.sparkSession)
    languages = model.languages
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    facts = source.select("id", "html", host_of(F.col("url")).alias("host"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(1).to_pylist()
            scores = [model.log_likelihoods(page_text(x)).tolist() for x in html]
            declared = [declared_language(x) for x in html]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], ["id", "host", "declared", "score"])

    kind = facts.select("id", "host").withColumn("declared", F.lit(None).cast("string")).withColumn("score", F.array(F.lit(0.0))).schema
    if not languages:
        plain = facts.mapInArrow(score, kind)
        return plain.select(F.col("id").alias(id), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), "declared", "host")
    suffix = F.regexp_extract("host", r"([^.]+)$", 1)
    posterior = _softmax(F.col("score"))
    scored = cut_lineage(facts.mapInArrow(score, kind).withColumn("suffix", suffix).withColumn("q", posterior))
    own = [F.col("q")[k] for k in range(len(languages))]
    sums = lambda name: [F.sum(own[k]).alias(f"{name}{k}") for k in range(len(languages))]
    n = F.count(F.lit(1))
    whole = scored.agg(*sums("all_"), n.alias("n_all"))
    by_suffix = cut_lineage(scored.where("suffix IS NOT NULL").groupBy("suffix").agg(*sums("suffix_"), n.alias("n_suffix")))
    by_host = cut_lineage(scored.where("host IS NOT NULL").groupBy("host").agg(*sums("host_"), n.alias("n_host")))
    # how pages of a language declare themselves, for declarations of known languages: a table of languages squared
    known = scored.where(F.col("declared").isin(*languages))
    said = {r["declared"]: [float(r[f"said_{k}"]) for k in range(len(languages))] for r in known.groupBy("declared").agg(*sums("said_")).collect()}
    total = [sum(said[d][k] for d in said) for k in range(len(languages))]
    table = {d: [float(np.log((said.get(d, [0.0] * len(languages))[k] + 1.0) / (total[k] + len(languages)))) for k in range(len(languages))] for d in languages}
    top = whole.first()
    size = max(1, top["n_all"] or 0)
    prior = [((top[f"all_{k}"] or 0.0) + 1.0) / (size + len(languages)) for k in range(len(languages))]
    # adaptive execution splits the partition of a host that holds a large share of the pages
    joined = scored.join(by_suffix, "suffix", "left").join(by_host.hint("merge"), "host", "left")
    evidence = []
    for k in range(len(languages)):
        less = lambda column, k=k: F.greatest(F.coalesce(F.col(column), F.lit(0.0)) - own[k], F.lit(0.0))
        others = lambda column: F.greatest(F.coalesce(F.col(column), F.lit(0)) - 1, F.lit(0))
        of_suffix = (less(f"suffix_{k}") + SUFFIX_WEIGHT * F.lit(prior[k])) / (others("n_suffix") + SUFFIX_WEIGHT)
        of_host = (less(f"host_{k}") + HOST_WEIGHT * of_suffix) / (others("n_host") + HOST_WEIGHT)
        markup = F.coalesce(*(F.when(F.col("declared") == d, F.lit(table[d][k])) for d in languages), F.lit(0.0))
        evidence.append(F.col("score")[k] + F.log(of_host) + DECLARED_WEIGHT * markup)
    fused = joined.select("id", "host", "declared", "q", F.array(*evidence).alias("score")).withColumn("fused", _softmax(F.col("score")))
    names = F.array(*(F.lit(x) for x in languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select(F.col("id").alias(id), best(F.col("fused")).alias("language"), F.array_max("fused").alias("probability"), best(F.col("q")).alias("text_language"), "declared", "host")


def _softmax(score: Column) -> Column:
    weights = F.transform(score, lambda s: F.exp(s - F.array_max(score)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))
