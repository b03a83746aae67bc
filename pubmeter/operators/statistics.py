"""Rank correlation, its test, quadrant classes and the density grid of a map."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.operators.counting import weighted_mean
from pubmeter.operators.ordering import average_rank, quantiles
from pubmeter.session import cut_lineage

# Pairs below which the test of untied ranks does not use Student's t, and up to which it counts permutations.
SMALL = 1_290
COUNTED = 9
# Bins of the density grid along each side.
BINS = 401


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``n``, the rank correlation ``r`` of two columns (average ranks), and its test."""
    return spearman_by(df.withColumn("_one", F.lit(0)), "_one", x, y).drop("_one")


def spearman_by(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """One row per ``by``: ``n``, the rank correlation ``r`` of two columns (average ranks), and its test.

    Works on the distinct value pairs and their counts, so repeated values cost nothing. Both columns of all groups are ranked
    in one pass. Rows without ``by`` or a value do not count.
    """
    known = df.where(F.col(by).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    cells = cut_lineage(pairs.groupBy("_by", "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
    axis = lambda name: F.struct("_by", F.lit(name).alias("axis")).alias("_axis")
    long = cells.select(axis("x"), F.col("_x").alias("_v"), "_w").unionByName(cells.select(axis("y"), F.col("_y").alias("_v"), "_w"))
    ranks = cut_lineage(average_rank(long, "_v", "_rank", F.col("_w"), "_axis"))
    side = lambda name: ranks.where(F.col("_axis.axis") == name).select(
        F.col("_axis._by").alias("_by"), F.col("_v").alias(f"_{name}"), F.col("_rank").alias(f"_r{name}"), F.col("n").alias(f"_n{name}")
    )
    ranked = cells.join(side("x"), ["_by", "_x"]).join(side("y"), ["_by", "_y"])
    # of n ranks the mean is (n + 1) / 2
    middle = (F.col("_all") + 1) / 2
    sizes = cells.groupBy("_by").agg(F.sum("_w").alias("_all"))
    centred = ranked.join(sizes, "_by").select("_by", "_w", (F.col("_rx") - middle).alias("dx"), (F.col("_ry") - middle).alias("dy"), "_nx", "_ny")
    w, dx, dy = F.col("_w"), F.col("dx"), F.col("dy")
    r = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))
    summed = centred.groupBy(F.col("_by").alias(by)).agg(F.sum(w).alias("n"), r.alias("r"), F.max(F.greatest("_nx", "_ny")).alias("_most"))
    return correlation_test(summed.withColumn("_untied", F.col("_most") == 1).drop("_most"), "_untied").drop("_untied")


def correlation_test(correlations: DataFrame, untied: str | None = None) -> DataFrame:
    """Adds the rank sum statistic ``s``, the ``t`` statistic and the two-sided ``p_value`` to rows of (n, r).

    Where the boolean column ``untied`` holds, fewer than ``SMALL`` pairs are tested by the distribution of ``s`` itself, otherwise
    by Student's t.
    """
    n, r = F.col("n"), F.col("r")
    tested = correlations.select(
        "*",
        ((n.cast("double") * n * n - n) * (1 - r) / 6).alias("s"),
        F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r)).alias("t"),
    )
    return tested.withColumn("p_value", _two_sided_p("s", "t", n.cast("double"), F.col(untied) if untied else F.lit(False)))


@F.pandas_udf(T.DoubleType())
def _two_sided_p(s: pd.Series, t: pd.Series, n: pd.Series, untied: pd.Series) -> pd.Series:
    exact = lambda a, c, u: u and c < SMALL and a is not None and not math.isnan(a)
    return pd.Series([rank_sum_p(a, int(c)) if exact(a, c, u) else student_p(b, c - 2) for a, b, c, u in zip(s, t, n, untied)])


def rank_sum_p(s: float, n: int) -> float | None:
    """Two-sided tail of the sum of squared rank differences of ``n`` untied pairs: counted, or by its series."""
    if n < 2:
        return None
    s = round(s)
    middle = (n**3 - n) / 6
    return min(1.0, 2 * (rank_sum_tail(s - 1, n, False) if s > middle else rank_sum_tail(s + 2, n, True)))


def rank_sum_tail(s: int, n: int, below: bool) -> float:
    """Chance that the sum is at least ``s``, or of the contrary with ``below``."""
    if s <= 0:
        return 0.0 if below else 1.0
    if s > (n**3 - n) / 3:
        return 1.0 if below else 0.0
    if n <= COUNTED:
        above = sum(c for total, c in rank_sum_counts(n).items() if total >= s) / math.factorial(n)
        return 1 - above if below else above
    # Edgeworth series of Best and Roberts (1975); fixed values
    c = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)
    b = 1 / n
    x = (6 * (s - 1) * b / (n * n - 1) - 1) * math.sqrt(n - 1)
    y = x * x
    u = x * b * (c[0] + b * (c[1] + c[2] * b) + y * (-c[3] + b * (c[4] + c[5] * b) - y * b * (c[6] + c[7] * b - y * (c[8] - c[9] * b + y * b * (c[10] - c[11] * y)))))
    above = u / math.exp(y / 2) + math.erfc(x / math.sqrt(2)) / 2
    return min(1.0, max(0.0, 1 - above if below else above))


def rank_sum_counts(n: int) -> dict[int, int]:
    """How many permutations of ``n`` ranks have each sum of squared differences, place by place over the sets of ranks used."""
    states: dict[int, dict[int, int]] = {0: {0: 1}}
    for place in range(n):
        following: dict[int, dict[int, int]] = {}
        for used, sums in states.items():
            for rank in range(n):
                if not used >> rank & 1:
                    to = following.setdefault(used | 1 << rank, {})
                    for total, count in sums.items():
                        to[total + (rank - place) ** 2] = to.get(total + (rank - place) ** 2, 0) + count
        states = following
    return states[(1 << n) - 1]


def student_p(t: float | None, df: float) -> float | None:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    if t is None or math.isnan(t) or df <= 0:
        return None
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    swap = x >= (a + 1.0) / (a + b + 2.0)
    if swap:
        x, a, b = 1.0 - x, b, a
    if x <= 0.0:
        return 1.0 if swap else 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # modified Lentz evaluation
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    tail = front * value
    return 1.0 - tail if swap else tail


def quadrant(x: Column, y: Column, mid_x: Column, mid_y: Column, labels: Sequence[str], otherwise: str) -> Column:
    """Class by two thresholds: (high x, high y), (high, low), (low, high), (low, low); unknown gets ``otherwise``."""
    return (
        F.when((x >= mid_x) & (y >= mid_y), labels[0])
        .when((x >= mid_x) & (y < mid_y), labels[1])
        .when((x < mid_x) & (y >= mid_y), labels[2])
        .when((x < mid_x) & (y < mid_y), labels[3])
        .otherwise(otherwise)
    )


def mean_threshold(df: DataFrame, value: str, weight: str) -> Column:
    """Weighted mean of a table as a scalar, usable in expressions on any table."""
    return df.agg(weighted_mean(F.col(value), F.col(weight)).alias("m")).scalar()


def density_grid(
    points: DataFrame, group: str, x: str, y: str, cells: int = 100, bandwidth: tuple[float, float] | None = None, bins: int = BINS
) -> DataFrame:
    """Gaussian kernel density of each group on a ``cells`` by ``cells`` grid over the range of all points.

    Points are shared out to the four nearest of ``bins`` by ``bins`` places, and the kernel then passes over these sums, once
    along x and once along y, so what is worked on per group depends on ``bins`` alone. A place of its own has no
    error; otherwise the density is off by at most ``(dx**2 / hx**2 + dy**2 / hy**2) / 8`` times the kernel's height
    ``1 / (2 pi hx hy)``, with the distances dx and dy of the places and the bandwidths hx and hy.

    The default bandwidth is the normal reference rule per group, on exact quartiles (the deviation alone where these are equal). Groups
    without spread in x or y have no density then, and no rows. Points without group or coordinate do not count.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    base = points.where(F.col(group).isNotNull() & px.isNotNull() & py.isNotNull()).select(F.col(group).alias("_g"), px.alias("_x"), py.alias("_y"))
    # one row of four numbers
    box = base.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    ends = {c: F.lit(box[c]).cast("double") for c in ("x0", "x1", "y0", "y1")}

    def shared(value: str, low: Column, high: Column) -> Column:
        at = F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)) * (bins - 1)
        left = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
        both = F.array(F.struct(left.alias("bin"), (1 - (at - left)).alias("w")), F.struct((left + 1).alias("bin"), (at - left).alias("w")))
        return F.filter(both, lambda b: b["w"] != 0)

    spread = base.select("_g", F.explode(shared("_x", ends["x0"], ends["x1"])).alias("bx"), shared("_y", ends["y0"], ends["y1"]).alias("by"))
    spread = spread.select("_g", "bx", F.explode("by").alias("by"))
    binned = spread.groupBy("_g", F.col("bx.bin").alias("i"), F.col("by.bin").alias("j")).agg(F.sum(F.col("bx.w") * F.col("by.w")).alias("w"))
    if bandwidth is None:
        widths = reference_bandwidths(base)
    else:
        widths = base.select("_g").distinct().select("_g", F.lit(float(bandwidth[0])).alias("hx"), F.lit(float(bandwidth[1])).alias("hy"))
    rows = binned.join(widths.where("hx > 0 AND hy > 0"), "_g").select("_g", "i", "j", "w", "hx", "hy", *(c.alias(n) for n, c in ends.items()))
    group_type = dict(rows.dtypes)["_g"]

    def density(table: pa.Table) -> pa.Table:
        weights = np.zeros((bins, bins))
        weights[table["i"].to_numpy(), table["j"].to_numpy()] = table["w"].to_numpy()
        hx, hy, x0, x1, y0, y1 = (table[c][0].as_py() for c in ("hx", "hy", "x0", "x1", "y0", "y1"))

        def kernel(low: float, high: float, h: float) -> tuple[np.ndarray, np.ndarray]:
            at, places = (low + (high - low) * np.arange(n) / (n - 1) for n in (cells, bins))
            return at, np.exp(-(((at[:, None] - places) / h) ** 2) / 2) / (h * math.sqrt(2 * math.pi))

        (gx, kx), (gy, ky) = kernel(x0, x1, hx), kernel(y0, y1, hy)
        found = kx @ weights @ ky.T / weights.sum()
        i, j = np.divmod(np.arange(cells * cells), cells)
        same = table["_g"].combine_chunks().take(pa.array(np.zeros(cells * cells, np.int64)))
        return pa.table({"_g": same, "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "x": gx[i], "y": gy[j], "density": found.ravel()})

    found = rows.groupBy("_g").applyInArrow(density, f"_g {group_type}, i int, j int, x double, y double, density double")
    return found.withColumnRenamed("_g", group)


def reference_bandwidths(base: DataFrame) -> DataFrame:
    """``_g, hx, hy``: 1.06 times the smaller of deviation and quartile distance over 1.34, times n to the power -1/5."""
    axis = lambda name, c: base.select(F.struct("_g", F.lit(name).alias("axis")).alias("_axis"), F.col(c).alias("_v"))
    long = axis("x", "_x").unionByName(axis("y", "_y"))
    quartiles = quantiles(long, "_v", [0.25, 0.75], "_axis")
    deviations = long.groupBy("_axis").agg(F.stddev_samp("_v").alias("_sd"))
    met = quartiles.join(deviations, "_axis")
    width = (F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34
    h = 1.06 * F.when(width > 0, F.least(F.col("_sd"), width)).otherwise(F.col("_sd")) * F.pow(F.col("n"), F.lit(-0.2))
    of = lambda name: F.max(F.when(F.col("_axis.axis") == name, h)).alias(f"h{name}")
    return met.groupBy(F.col("_axis._g").alias("_g")).agg(of("x"), of("y"))
