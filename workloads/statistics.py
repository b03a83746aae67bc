"""Rank correlation, weighted thresholds and density grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.ordering import quantiles
from pubmeter.operators.statistics import density_grid, spearman, spearman_by
from workloads.registry import Tables, query

RANKS = """
WITH v AS (SELECT o_custkey % 50 AS x, round(o_totalprice / 10000) AS y FROM orders),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v),
c AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM r)"""


def pairs(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 50).alias("x"), F.round(F.col("o_totalprice") / 10000).alias("y"))


@query(RANKS + " SELECT n, r FROM c", doubles="r")
def spearman_correlation(t: Tables) -> DataFrame:
    return spearman(pairs(t), "x", "y").select("n", "r")


@query(
    RANKS
    + """ SELECT n, (CAST(n AS DOUBLE) * n * n - n) * (1 - r) / 6 / (CAST(n AS DOUBLE) * n * n) AS s_scaled,
    r * sqrt((n - 2) / (1 - r * r)) AS t FROM c""",
    doubles="s_scaled t",
)
def spearman_test(t: Tables) -> DataFrame:
    result = spearman(pairs(t), "x", "y")
    cube = F.col("n").cast("double") * F.col("n") * F.col("n")
    return result.select("n", (F.col("s") / cube).alias("s_scaled"), "t")


# Two-sided tail of Student's t with n - 2 degrees of freedom: cos(u) ** (n - 3) over the angle u by Simpson's rule.
STUDENT = """
nodes AS (SELECT {0}, n, atan(abs(t) / sqrt(n - 2)) AS u0, unnest(range(4001)) AS k FROM tested),
curve AS (SELECT {0}, n, k, (least(pi() / 2, u0 + 12 / sqrt(n - 2)) - u0) / 4000 AS h, pow(greatest(0, cos(u0 + k * (least(pi() / 2, u0 + 12 / sqrt(n - 2)) - u0) / 4000)), n - 3) AS f FROM nodes),
tail AS (SELECT {0}, 2 * exp(lgamma((any_value(n) - 1) / 2) - lgamma((any_value(n) - 2) / 2)) / sqrt(pi()) * any_value(h) / 3
  * sum(f * CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) AS p FROM curve GROUP BY {0})"""


@query(RANKS + ", tested AS (SELECT 1 AS g, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c), " + STUDENT.format("g") + " SELECT n, p AS p_value FROM tested JOIN tail USING (g)", doubles="p_value")
def spearman_p_value(t: Tables) -> DataFrame:
    """The reported significance of a rank correlation with ties, by Student's t."""
    return spearman(pairs(t), "x", "y").select("n", "p_value")


NATION_SALES = """
v AS (SELECT n_regionkey AS region, n_nationkey, count(*) AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
k AS (SELECT region, n_nationkey, x + n_nationkey / 100 AS x, y FROM v)"""


@query(
    f"""WITH {NATION_SALES}, ranks AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY x) AS rx, rank() OVER (PARTITION BY region ORDER BY y) AS ry FROM k),
    s AS (SELECT region, count(*) AS n, sum(pow(rx - ry, 2)) AS s FROM ranks GROUP BY region),
    perms AS (SELECT pow(a.i - 1, 2) + pow(b.i - 2, 2) + pow(c.i - 3, 2) + pow(d.i - 4, 2) + pow(e.i - 5, 2) AS s FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5)
    SELECT region, n, 1 - s / 20 AS r, s, least(1.0, 2 * (SELECT count(*) FILTER (CASE WHEN o.s > 20 THEN p.s >= o.s ELSE p.s <= o.s END) / 120 FROM perms p)) AS p_value FROM s o""",
    doubles="r s p_value",
)
def spearman_by_region(t: Tables) -> DataFrame:
    """Rank correlations of number and value of orders over the nations of each region, tested by counting permutations."""
    sold = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("x"), F.sum("o_totalprice").alias("y"))
    named = t.nation.join(sold, F.col("n_nationkey") == F.col("c_nationkey"))
    values = named.select(F.col("n_regionkey").alias("region"), (F.col("x") + F.col("n_nationkey") / 100).alias("x"), "y")
    return spearman_by(values, "region", "x", "y").select("region", "n", "r", "s", "p_value")


@query(
    """SELECT l_returnflag AS mode, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.1) AS low, quantile_cont(l_extendedprice, 0.5) AS middle, quantile_cont(l_extendedprice, 0.99) AS high
    FROM lineitem GROUP BY l_returnflag""",
    doubles="low middle high",
)
def exact_quantiles(t: Tables) -> DataFrame:
    """Order statistics of each group by ranges of its values."""
    found = quantiles(t.lineitem, "l_extendedprice", [0.1, 0.5, 0.99], "l_returnflag")
    return found.select(F.col("l_returnflag").alias("mode"), "n", *(F.col("quantiles")[k].alias(c) for k, c in enumerate(("low", "middle", "high"))))


# Quantities and discounts fall on places of the grid of 491 by 491, where sharing out has no error.
@query(
    """WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
    cells AS (SELECT g, x, y, count(*) AS w FROM p GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM p GROUP BY g),
    grid AS (SELECT i, j FROM range(8) a(i), range(8) b(j))
    SELECT c.g, i, j, any_value(x0 + (x1 - x0) * i / 7) AS x, any_value(y0 + (y1 - y0) * j / 7) AS y,
      sum(w * exp(-pow((c.x - (x0 + (x1 - x0) * i / 7)) / 5.0, 2) / 2) * exp(-pow((c.y - (y0 + (y1 - y0) * j / 7)) / 2.0, 2) / 2)) / (2 * pi() * any_value(n.n) * 10.0) AS density
    FROM cells c JOIN n ON c.g = n.g, b, grid GROUP BY c.g, i, j""",
    doubles="x y density",
)
def density_by_class(t: Tables) -> DataFrame:
    points = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return density_grid(points, "g", "x", "y", 8, (5.0, 2.0), 491)


@query(
    """WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
    cells AS (SELECT g, x, y, count(*) AS w FROM p GROUP BY ALL),
    n AS (SELECT g, count(*) AS n, 1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS hx,
      1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS hy FROM p GROUP BY g),
    grid AS (SELECT i, j FROM range(8) a(i), range(8) b(j))
    SELECT c.g, i, j, sum(w * exp(-pow((c.x - (x0 + (x1 - x0) * i / 7)) / hx, 2) / 2) * exp(-pow((c.y - (y0 + (y1 - y0) * j / 7)) / hy, 2) / 2)) / (2 * pi() * any_value(n.n * hx * hy)) AS density
    FROM cells c JOIN n ON c.g = n.g, b, grid GROUP BY c.g, i, j""",
    doubles="density",
)
def density_with_own_bandwidth(t: Tables) -> DataFrame:
    """The bandwidth of each class from its own deviation and exact quartiles."""
    points = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return density_grid(points, "g", "x", "y", 8, bins=491).select("g", "i", "j", "density")
