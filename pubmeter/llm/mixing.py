"""Mixing by soft membership: document rates that bring expected domain totals to target weights. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.session import cut_lineage

TARGETS = {"high": 0.92, "low": 0.08}
STEPS = 60
TOLERANCE = 1e-5
# Upper ends of the bins of each feature.
RATE_BINS = (0.0, 0.005, 0.02, 0.1, 0.3, 1.0)
RATIO_BINS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
WIDTH_BINS = (2.5, 3.5, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0)
SIZE_BINS = (10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0)
FEATURES = ("symbols", "bars", "calls", "variety", "width")


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    """Number of ends below the value."""
    return sum((F.when(value > end, 1).otherwise(0) for end in ends), F.lit(0)).cast("int")


def _taken(text: Column, *marks: str) -> Column:
    """Bytes of the marks in the text."""
    left = text
    for mark in marks:
        left = F.replace(left, F.lit(mark), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def features(docs: DataFrame, text: str, **kept: Column) -> DataFrame:
    """The columns ``kept``, ``tokens`` (words) of each text and the bins of its dense features, all from built-in functions."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # words are parted by blanks, tabs and line ends
    words = F.array_remove(F.split(F.replace(F.replace(F.replace(value, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")), " "), "")
    # measured once, in a step of its own: the bins name each measure many times
    measured = docs.select(
        *(c.alias(name) for name, c in kept.items()),
        F.size(words).cast("long").alias("tokens"),
        F.size(F.array_distinct(words)).alias("different"),
        _taken(value, "#", "*", "$", "%", "&", "<", ">").alias("n_symbols"),
        _taken(value, "|").alias("n_bars"),
        _taken(value, "!!", "??").alias("n_calls"),
        F.octet_length(value).alias("n_bytes"),
    )
    per = lambda name: F.col(name) / F.greatest(F.col("tokens"), F.lit(1))
    # the variety of words falls with length, so both count together
    variety = _bin(per("different"), RATIO_BINS) * (len(SIZE_BINS) + 1) + _bin(F.col("tokens").cast("double"), SIZE_BINS)
    bins = [_bin(per("n_symbols"), RATE_BINS).alias("symbols"), _bin(per("n_bars"), RATE_BINS).alias("bars"), _bin(per("n_calls"), RATE_BINS).alias("calls")]
    return measured.select(*kept, "tokens", *bins, variety.alias("variety"), _bin(per("n_bytes"), WIDTH_BINS).alias("width"))


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: the classifier's log odds by feature and bin, and the residuals of each descent step."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    # feature -> bin -> log probability for each domain; the last row of a feature stands for bins without a labelled row
    odds: dict[str, dict[int, tuple[float, ...]]]
    residuals: tuple[tuple[float, ...], ...] = ()
    most: float | None = None

    def posterior(self, made: DataFrame) -> DataFrame:
        """``made`` and ``q``, the array of the domains' probabilities."""
        def looked_up(name: str, k: int) -> str:
            known = ", ".join(f"{b}, {_number(v[k])}" for b, v in self.odds[name].items() if b >= 0)
            other = _number(self.odds[name][-1][k])
            return f"coalesce(map({known})[{name}], {other})" if known else other

        scores = [" + ".join([_number(self.prior[k]), *(looked_up(name, k) for name in FEATURES)]) for k in range(len(self.domains))]
        # each step names the one before twice, so that it is computed once
        weighed = made.withColumn("q", F.expr(f"array({', '.join(scores)})")).withColumn("q", F.expr("transform(q, s -> exp(s - array_max(q)))"))
        return weighed.withColumn("q", F.expr("transform(q, w -> w / aggregate(q, 0D, (a, b) -> a + b))"))

    def rate(self) -> Column:
        """The rate of a document with probabilities ``q``: each step lowers it by the share of the residuals and projects it."""
        steps = ", ".join(f"array({', '.join(map(_number, r))})" for r in self.residuals)
        moved = "greatest(r - aggregate(zip_with(q, e, (a, b) -> a * b), 0D, (a, b) -> a + b), 0D)"
        if self.most is not None:
            moved = f"least({moved}, {_number(self.most)})"
        return F.expr(f"CASE WHEN size(q) > 0 THEN aggregate(array({steps}), 1D, (r, e) -> {moved}) END") if steps else F.lit(1.0)


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, tokens and bins of each row, written out: what ``fit`` and ``rates`` both read instead of the texts."""
    return cut_lineage(features(docs, text, id=F.col(f"`{id}`")))


def fit(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text", label: str = "domain",
    most: float | None = None, steps: int = STEPS, measured: DataFrame | None = None,
) -> Mixture:
    """Rates for the documents of ``docs``; ``labelled`` has ``id`` and ``label``, one of the keys of ``targets`` or another value.

    The classifier is naive Bayes over binned dense features of all labelled documents. Documents of equal bins are alike to
    it, so the descent works on one row per combination of bins with its sum of tokens. The objective is half the sum over
    domains of ``(total - target)^2 / expected total at rate one``; in the metric of tokens its gradient for a document is
    its posterior times the residuals, with a Lipschitz bound of one, so a step of one descends. Targets are the weights
    times the largest budget that asks of no domain more than it has. Each step is one aggregation; what reaches the driver
    is one number per domain. ``most`` bounds the rates from above too.
    """
    domains = tuple(targets)
    made = measured if measured is not None else measure(docs, id, text)
    known = labelled.select(F.col(id).alias("id"), F.col(label).alias("domain")).where(F.col("domain").isin(*domains) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    bins = F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name in FEATURES)))
    joined = made.join(known, "id").select("domain", bins.alias("b"))
    # features times bins times domains: a few hundred rows
    counted = joined.groupBy("domain", "b.feature", "b.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {d: sum(r["n"] for r in counted if r["domain"] == d and r["feature"] == FEATURES[0]) for d in domains}
    every = sum(totals.values()) + len(domains)
    prior = tuple(math.log((totals[d] + 1) / every) for d in domains)
    odds: dict[str, dict[int, tuple[float, ...]]] = {}
    for name in FEATURES:
        seen = {(r["domain"], r["bin"]): r["n"] for r in counted if r["feature"] == name}
        found = sorted({b for _, b in seen})
        share = lambda d, b, size=len(found) + 1: math.log((seen.get((d, b), 0) + 0.5) / (totals[d] + 0.5 * size))  # noqa: E731, B023
        odds[name] = {b: tuple(share(d, b) for d in domains) for b in found} | {-1: tuple(share(d, -1) for d in domains)}
    model = Mixture(domains, prior, odds, (), most)
    alike = cut_lineage(model.posterior(made.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens"))).select("tokens", "q"))

    def expected(residuals: tuple) -> list[float]:
        rate = Mixture(domains, prior, odds, residuals, most).rate()
        row = alike.select(rate.alias("r"), "tokens", "q").agg(*(F.coalesce(F.sum(F.col("r") * F.col("tokens") * F.col("q")[k]), F.lit(0.0)) for k in range(len(domains)))).first()
        return [float(x) for x in row]

    start = expected(())
    weight = sum(targets.values())
    budget = min((have / (targets[d] / weight) for d, have in zip(domains, start) if targets[d] > 0), default=0.0)
    goals = [budget * targets[d] / weight for d in domains]
    residuals: tuple[tuple[float, ...], ...] = ()
    now = start
    for _ in range(steps):
        gap = tuple((x - g) / s if s > 0 else 0.0 for x, g, s in zip(now, goals, start))
        if max(map(abs, gap), default=0.0) < TOLERANCE:
            break
        residuals += (gap,)
        before, now = now, expected(residuals)
        if max((abs(x - y) / s for x, y, s in zip(before, now, start) if s > 0), default=0.0) < TOLERANCE:
            break
    return Mixture(domains, prior, odds, residuals, most)


def rates(docs: DataFrame, model: Mixture, id: str = "doc_id", text: str = "text", measured: DataFrame | None = None) -> DataFrame:
    """``id, tokens, posterior, rate, copies``: one row per row.

    ``copies`` is the rate rounded up or down by a hash of the id, so that its mean is the rate; a missing text has no
    tokens and the rate that its features give, a missing id draws with the hash of a missing value, repeated rows draw
    alike. An empty table gives no rows.
    """
    made = measured if measured is not None else features(docs, text, id=F.col(f"`{id}`"))
    scored = model.posterior(made).withColumn("rate", model.rate())
    return scored.select(F.col("id").alias(id), "tokens", F.col("q").alias("posterior"), "rate", _drawn(F.col("rate"), F.col("id")).alias("copies"))


def _drawn(rate: Column, id: Column) -> Column:
    place = F.pmod(F.xxhash64(id, F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(place < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def draw(docs: DataFrame, model: Mixture, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says."""
    names = docs.columns
    held = features(docs, text, row=F.struct(*(F.col(f"`{c}`") for c in names)), id=F.col(f"`{id}`"))
    # the partition's number keeps the optimizer from testing the rate before, and again after, it is computed
    copies = _drawn(F.col("rate"), F.col("id")) + F.when(F.spark_partition_id() < 0, 1).otherwise(0)
    drawn = model.posterior(held).withColumn("rate", model.rate()).select("row", copies.cast("int").alias("copies")).where("copies > 0")
    if model.most is None or model.most > 1:
        drawn = drawn.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in names))
