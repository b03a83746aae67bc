"""Vectors: similarity, neighbours, clusters, components and centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.vectors import cosine, rescale
from pubmeter.operators.buckets import nearest_in_buckets
from pubmeter.operators.clustering import density_cluster, density_leaves
from pubmeter.operators.embedding import principal_components, principal_components_by
from pubmeter.operators.neighbours import nearest
from pubmeter.operators.tokens import topic_centroids
from pubmeter.plans.topics import topic_map
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import prelude


@query(prelude("vectors", "centroids") + "SELECT v.id, round(list_cosine_similarity(v.vec, c.vec), 6) AS similarity FROM vectors v JOIN centroids c ON v.topic = c.topic", doubles="similarity")
def cosine_to_centroid(t: Tables) -> DataFrame:
    v = roles.vectors(t)
    means = topic_centroids(v).select("topic", F.col("vec").alias("c"))
    return v.join(means, "topic").select("id", cosine(F.col("vec"), F.col("c")).alias("similarity"))


@query(prelude("vectors", "centroids") + "SELECT topic, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS value FROM centroids", doubles="value")
def centroid_vectors(t: Tables) -> DataFrame:
    means = topic_centroids(roles.vectors(t))
    return means.select("topic", F.posexplode("vec").alias("pos", "value"))


@query(
    prelude("vectors")
    + """SELECT id, generate_subscripts(vec, 1) - 1 AS pos, 10000 * unnest(vec) / s AS value FROM vectors, (SELECT stddev_pop(vec[1]) * 10000 AS s FROM vectors)""",
    doubles="value",
)
def rescaled_vectors(t: Tables) -> DataFrame:
    scaled = rescale(roles.vectors(t), "vec")
    return scaled.select("id", F.posexplode("vec").alias("pos", "value")).withColumn("value", 10_000 * F.col("value"))


NEAR = """near AS (SELECT id, neighbour, distance, rank FROM (SELECT a.id, b.id AS neighbour, round(1 - list_cosine_similarity(a.vec, b.vec), 9) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.vec, b.vec), 9), b.id) AS rank
  FROM vectors a JOIN vectors b ON a.id <> b.id) WHERE rank <= 10)"""


@query(prelude("vectors").rstrip() + f", {NEAR} SELECT id, neighbour, round(distance, 6) AS distance, rank FROM near", doubles="distance")
def nearest_neighbours(t: Tables) -> DataFrame:
    """Exact ten nearest by cosine, every block pair in its own task."""
    v = roles.vectors(t)
    return nearest(v, v, 10, skip_same_id=True)


@query(
    prelude("vectors").rstrip()
    + f""", {NEAR}, core AS (SELECT id FROM near WHERE rank = 3 AND distance <= 0.62),
    linked AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON round(1 - list_cosine_similarity(a.vec, b.vec), 9) <= 0.62
      WHERE a.id IN (SELECT id FROM core) AND b.id IN (SELECT id FROM core)),
    comp AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
      SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
    big AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS topic FROM comp GROUP BY component HAVING count(*) >= 4)
    SELECT v.id, coalesce(big.topic, -1) AS topic FROM vectors v LEFT JOIN comp ON v.id = comp.id LEFT JOIN big ON comp.component = big.component"""
)
def density_clusters(t: Tables) -> DataFrame:
    """Core points, close pairs, connected components, minimum size."""
    return density_cluster(roles.vectors(t), 0.62, min_samples=3, min_cluster_size=4)


# Three rounds of squaring modulo a prime draw the normals of the hyperplanes.
def _mixed(x: str, rounds: int = 3) -> str:
    return x if not rounds else f"({_mixed(x, rounds - 1)} % 2147483647 * ({_mixed(x, rounds - 1)} % 2147483647) + 12345) % 2147483647"


PLACES = (0, 1, 2, 3, 4, 6, 8, 12, 16)
PLANES = f"""plane AS (SELECT t, b, list(CASE WHEN {_mixed("((t * 16 + b) * 1048576 + i)")} > 1073741823 THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY i) AS v
  FROM (SELECT t.t, b.b, i.i FROM range(8) t(t), range(16) b(b), range(1, 65) i(i)) GROUP BY t, b),
signed AS (SELECT id, t, CAST(sum(CASE WHEN round(list_dot_product(vec, v), 9) >= 0 THEN 1 << (15 - CAST(b AS INTEGER)) ELSE 0 END) AS BIGINT) AS s FROM vectors, plane GROUP BY id, t),
shared AS (SELECT id, t, s, d, s >> (16 - d) AS p, count(*) OVER (PARTITION BY t, d, s >> (16 - d)) AS n FROM signed, (SELECT unnest([{", ".join(map(str, PLACES))}]) AS d)),
leaf AS (SELECT id, t, min(d) AS d, arg_min(p, d) AS p FROM shared WHERE n <= 120 OR d = 16 GROUP BY id, t),
met AS (SELECT DISTINCT a.id, b.id AS neighbour FROM leaf a JOIN leaf b ON a.t = b.t AND a.d = b.d AND a.p = b.p AND a.id <> b.id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM
  (SELECT m.id, m.neighbour, round(1 - list_cosine_similarity(a.vec, b.vec), 9) AS distance FROM met m JOIN vectors a ON a.id = m.id JOIN vectors b ON b.id = m.neighbour)) WHERE rank <= 10)"""


@query(prelude("vectors").rstrip() + f", {PLANES} SELECT id, neighbour, round(distance, 6) AS distance, rank FROM found", doubles="distance")
def neighbours_in_buckets(t: Tables) -> DataFrame:
    """Ten nearest among those that share a bucket of hyperplanes in one of eight tables; large buckets are split."""
    v = roles.vectors(t)
    return nearest_in_buckets(v, v, 10, skip_same_id=True, tables=8, limit=120, bits=16, depths=PLACES)


LEVELS = (0.56, 0.58, 0.6, 0.62, 0.64, 0.66)
LEAVES = f"""core AS (SELECT id, distance AS c FROM near WHERE rank = 3),
edge AS (SELECT n.id AS a, n.neighbour AS b, greatest(distance, x.c, y.c) AS w FROM near n JOIN core x ON x.id = n.id JOIN core y ON y.id = n.neighbour WHERE rank <= 6),
lev AS (SELECT unnest([{", ".join(map(str, LEVELS))}]) AS x, generate_subscripts([{", ".join(map(str, LEVELS))}], 1) AS l),
linked AS (SELECT l, a, b FROM edge JOIN lev ON w <= x UNION SELECT l, b, a FROM edge JOIN lev ON w <= x),
comp AS (WITH RECURSIVE reach(l, a, b) AS (SELECT l, a, b FROM linked UNION SELECT r.l, r.a, e.b FROM reach r JOIN linked e ON r.l = e.l AND r.b = e.a)
  SELECT l, a AS id, least(a, min(b)) AS component FROM reach GROUP BY l, a),
big AS (SELECT l, component, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) >= 4),
seed AS (SELECT b.l, b.component FROM big b WHERE NOT EXISTS (SELECT 1 FROM big c JOIN comp u ON u.l = b.l AND u.id = c.component WHERE c.l = b.l - 1 AND u.component = b.component)),
held AS (SELECT c.l, c.component, count(*) AS n, min(s.component) AS s FROM seed s JOIN comp c ON c.id = s.component AND c.l >= s.l GROUP BY ALL),
ends AS (SELECT s, max(l) AS l, arg_max(component, l) AS component FROM held WHERE n = 1 GROUP BY s),
named AS (SELECT e.l, e.component, row_number() OVER (ORDER BY size DESC, e.component) - 1 AS topic FROM ends e JOIN big b ON b.l = e.l AND b.component = e.component),
leafed AS (SELECT c.id, topic FROM named n JOIN comp c ON c.l = n.l AND c.component = n.component)"""


@query(prelude("vectors").rstrip() + f", {NEAR}, {LEAVES} SELECT v.id, coalesce(f.topic, -1) AS topic FROM vectors v LEFT JOIN leafed f ON v.id = f.id")
def density_leaf_clusters(t: Tables) -> DataFrame:
    """Clusters at the levels of density at which each stands alone, from a minimum spanning forest."""
    return density_leaves(roles.vectors(t), min_samples=3, min_cluster_size=4, neighbours=6, levels=LEVELS, bridge=False)


@query()
def principal_component_scores(t: Tables) -> DataFrame:
    """Five components of the centred vectors; the factorisation has no SQL form."""
    scores = principal_components(roles.vectors(t), "vec", 5)
    return scores.select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(
    prelude("vectors").rstrip()
    + """, long AS (SELECT id, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM vectors), centre AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos)
    SELECT id, sum((x - m) * (x - m)) AS square FROM long JOIN centre USING (pos) GROUP BY id""",
    doubles="square",
)
def principal_component_lengths(t: Tables) -> DataFrame:
    """All components together keep each centred vector's length."""
    scores = principal_components(roles.vectors(t), "vec", 64)
    return scores.select("id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("square"))


@query()
def topic_coordinates(t: Tables) -> DataFrame:
    """Two coordinates per topic, through a few principal components."""
    return topic_map(topic_centroids(roles.vectors(t)), 5)


PARTED = """parted AS (SELECT id, CAST(id % 3 AS INTEGER) AS part, vec FROM vectors),
long AS (SELECT id, part, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM parted), centre AS (SELECT part, pos, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY ALL)"""


def parted(t: Tables) -> DataFrame:
    return roles.vectors(t).withColumn("part", (F.col("id") % 3).cast("int"))


@query(prelude("vectors").rstrip() + f", {PARTED} SELECT l.id, l.part, sum((x - m) * (x - m)) AS square FROM long l JOIN centre c ON l.part = c.part AND l.pos = c.pos GROUP BY ALL", doubles="square")
def component_lengths_by_part(t: Tables) -> DataFrame:
    """All components of each part's own fit together keep its centred vectors' lengths."""
    scores = principal_components_by(parted(t), "vec", 64, "part")
    return scores.select("id", "part", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("square"))


@query(prelude("vectors").rstrip() + f", {PARTED} SELECT part, sum(v) AS total, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS crossed, true AS falling FROM centre GROUP BY part", doubles="total")
def component_moments_by_part(t: Tables) -> DataFrame:
    """Scores of each part: their means and cross-products are zero, their variances fall and add up to the part's own."""
    scores = principal_components_by(parted(t), "vec", 64, "part").select("part", "vec")
    one = scores.select("part", F.posexplode("vec").alias("i", "x")).groupBy("part", "i").agg(F.var_pop("x").alias("v"), F.abs(F.round(F.avg("x"), 6)).alias("m"))
    single = one.groupBy("part").agg(F.sum("v").alias("total"), F.max("m").alias("mean"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs"))
    steps = F.transform(F.slice("vs", 2, 63), lambda a: a["v"] <= F.element_at("vs", a["i"])["v"] + 1e-9)
    pairs = scores.select("part", F.posexplode("vec").alias("i", "x"), "vec").select("part", "i", "x", F.posexplode(F.slice("vec", 1, 5)).alias("j", "y")).where("i < 5 AND i < j")
    crossed = pairs.groupBy("part", "i", "j").agg(F.abs(F.round(F.avg(F.col("x") * F.col("y")), 6)).alias("c")).groupBy("part").agg(F.max("c").alias("crossed"))
    return single.join(crossed, "part").select("part", "total", "mean", "crossed", F.forall(steps, lambda x: x).alias("falling"))


@query(prelude("vectors", "centroids") + "SELECT count(*) AS topics, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS xy, true AS wider, (SELECT count(*) FROM centroids) AS apart FROM centroids")
def topic_coordinate_moments(t: Tables) -> DataFrame:
    """The map of the topics is centred, its axes are uncorrelated, x is the wider one, and no two topics fall together."""
    flat = topic_map(topic_centroids(roles.vectors(t)), 5)
    zero = lambda c: F.abs(F.round(c, 6))
    moments = flat.agg(F.count(F.lit(1)).alias("topics"), zero(F.avg("x")).alias("x"), zero(F.avg("y")).alias("y"), zero(F.covar_pop("x", "y")).alias("xy"), (F.var_pop("x") >= F.var_pop("y")).alias("wider"),
        F.count_distinct(F.round("x", 9), F.round("y", 9)).alias("apart"))
    return moments
