"""Density clusters of vectors: at one density level, or the leaves of a tree of levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.neighbours import BLOCK, lightest_bridges, nearest, similarity_forest
from pubmeter.operators.ordering import quantiles, row_index, running_total
from pubmeter.operators.skew import skew_join
from pubmeter.session import cut_lineage

# Fixed values of the published study.
MIN_SAMPLES = 10
MIN_CLUSTER_SIZE = 100
OUTLIER = -1
# Levels of density at which clusters are told apart.
LEVELS = 50


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every end of an edge; the component is its smallest id.

    In every round a node and the root it points to both take the smallest label among the node's neighbours,
    and then every label is replaced by the label of that label. The number of rounds grows with the logarithm
    of the longest path. Labels are written out between the steps.
    """
    ends = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = cut_lineage(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        current = labels.select(F.col("id").alias("src"), F.col("component").alias("_near"))
        heard = skew_join(both, current, "src", "inner", both).groupBy(F.col("dst").alias("id")).agg(F.min("_near").alias("_near"))
        told = labels.join(heard, "id")
        own = told.select("id", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        root = told.select(F.col("component").alias("id"), F.col("_near").alias("component"), F.lit(None).cast(own.schema["_old"].dataType).alias("_old"))
        hopped = cut_lineage(own.unionByName(root).groupBy("id").agg(F.min("component").alias("component"), F.max("_old").alias("_old")))
        roots = hopped.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        jumped = skew_join(hopped, roots, "component", "inner", hopped)
        labels = cut_lineage(jumped.select("id", F.least("component", "_root").alias("component"), "_old"))
        if labels.where(F.col("component") != F.col("_old")).isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("_old")


def density_cluster(
    df: DataFrame,
    eps: float,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    min_samples: int = MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    metric: str = "cosine",
    block: int = BLOCK,
) -> DataFrame:
    """``id, topic``: topics numbered from 0 by falling size (within ``by``), and -1 for outliers.

    A point is a core point if its ``min_samples``-th neighbour lies within ``eps``; core points within ``eps``
    of each other share a cluster, and clusters below ``min_cluster_size`` dissolve. This is one density
    level for the whole table, not a choice of leaves from a hierarchy of levels. Ids are unique over all groups.
    """
    near = nearest(df, df, min_samples, id, vec, by, metric, skip_same_id=True, block=block)
    core_ids = near.where((F.col("rank") == min_samples) & (F.col("distance") <= eps)).select(F.col("id").alias(id))
    core = cut_lineage(df.select(*([by] if by else []), id, vec).join(core_ids, id))
    forest = similarity_forest(core, eps, id, vec, by, metric, block)
    # A core point with min_samples >= 1 has a neighbour within eps, but that neighbour may not be a core point.
    alone = core.select(F.col(id).alias("a"), F.col(id).alias("b"))
    components = connected_components(forest.unionByName(alone)).withColumnRenamed("id", id)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_cluster_size)
    if by:
        # The group of a component is the group of its smallest id.
        sizes = sizes.join(core.select(F.col(id).alias("component"), F.col(by).alias("_by")), "component")
    else:
        sizes = sizes.withColumn("_by", F.lit(0))
    topics = _numbered(sizes)
    assigned = skew_join(components, topics, "component", "inner", components).select(id, "topic")
    keys = [*([by] if by else []), id]
    return df.select(*keys).join(assigned, id, "left").select(*keys, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))


def _numbered(clusters: DataFrame) -> DataFrame:
    """``component, topic`` of ``component, _by, _size``: numbers from 0 in each ``_by``, larger clusters first."""
    ordered = clusters.select("component", "_by", F.struct((-F.col("_size")).alias("less"), "component").alias("_order"))
    return running_total(ordered, "_order", F.lit(1), "topic", "_by").select("component", F.col("topic").cast("int").alias("topic"))


def minimum_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w") -> DataFrame:
    """``a, b, w``: a minimum spanning forest of the graph, by rounds of Boruvka.

    In each round every component takes its lightest edge to another one and the components that these join become one, so their
    number at least halves. Equal weights are told apart by the ends. Edges within a component are dropped as it grows.
    """
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).alias("w")).where("a <> b")
    left = cut_lineage(ends.groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = left.select("a", "b", "w").limit(0)
    while not left.isEmpty():
        edge = lambda other: F.struct("w", "a", "b", F.col(other).alias("to"))
        options = F.explode(F.array(F.struct(F.col("ca").alias("id"), edge("cb").alias("edge")), F.struct(F.col("cb").alias("id"), edge("ca").alias("edge")))).alias("o")
        lightest = cut_lineage(left.select(options).groupBy("o.id").agg(F.min("o.edge").alias("edge")))
        forest = forest.unionByName(lightest.select("edge.a", "edge.b", "edge.w").distinct())
        roots = _roots(lightest.select("id", F.col("edge.to").alias("to")))
        for side in ("ca", "cb"):
            left = left.join(roots.withColumnRenamed("id", side), side).withColumn(side, F.col("root")).drop("root")
        left = cut_lineage(left.where("ca <> cb"))
    return cut_lineage(forest)


def bridged(rows: DataFrame, forest: DataFrame, metric: str) -> DataFrame:
    """``a, b, w``: the forest with the lightest bridges that join its components within ``_by``, by rounds of Boruvka.

    ``rows`` is ``_by, id, vec, core``.
    """
    found = connected_components(forest)
    labels = cut_lineage(rows.select("_by", "id").join(found, "id", "left").select("_by", "id", F.coalesce("component", "id").alias("component")))
    while True:
        apart = labels.groupBy("_by").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("_by")
        open_rows = cut_lineage(rows.join(labels.join(apart, "_by").select("id", "component"), "id"))
        if open_rows.isEmpty():
            return cut_lineage(forest)
        bridges = lightest_bridges(open_rows, metric).select(F.col("component").alias("id"), F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "to").alias("edge"))
        lightest = cut_lineage(bridges.groupBy("id").agg(F.min("edge").alias("edge")))
        forest = forest.unionByName(lightest.select("edge.a", "edge.b", "edge.w").distinct())
        roots = _roots(lightest.select("id", F.col("edge.to").alias("to"))).withColumnRenamed("id", "component")
        labels = cut_lineage(labels.join(roots, "component", "left").select("_by", "id", F.coalesce("root", "component").alias("component")))


def _roots(pointers: DataFrame) -> DataFrame:
    """``id, root`` where every id points to another one (``to``) and pointers end in pairs that point to each other: the smaller is the root.

    Pointers are followed by doubling, so in logarithmic rounds.
    """
    back = pointers.select(F.col("id").alias("to"), F.col("to").alias("_back"))
    mutual = (F.col("_back") == F.col("id")) & (F.col("id") < F.col("to"))
    now = cut_lineage(pointers.join(back, "to").select("id", F.when(mutual, F.col("id")).otherwise(F.col("to")).alias("root"), F.lit(True).alias("moved")))
    while True:
        beyond = now.select(F.col("id").alias("root"), F.col("root").alias("_beyond"))
        now = cut_lineage(now.join(beyond, "root").select("id", F.col("_beyond").alias("root"), (F.col("root") != F.col("_beyond")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def density_leaves(
    df: DataFrame,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    min_samples: int = MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    metric: str = "cosine",
    neighbours: int | None = None,
    levels: Sequence[float] | int = LEVELS,
    epsilon: float | None = None,
    find: Callable[..., DataFrame] = nearest,
    bridge: bool = True,
) -> DataFrame:
    """``id, topic``: the leaves of the tree of density levels, numbered from 0 by falling size (within ``by``); -1 for outliers.

    A row's core distance is that to its ``min_samples``-th neighbour; the distance by which two rows reach each other is the largest of
    their distance and both core distances. Rows are linked with their ``neighbours`` nearest (by default twice
    ``min_samples``), and a minimum spanning forest holds the components at every level of that distance. A component counts from
    ``min_cluster_size`` rows on. Where two that count become one, both have ended; a leaf is a component just
    before its first such end, or at the last level. So clusters of different densities are each found at a level of their own.

    ``levels`` are distances, or the number of levels, which then are the quantiles of the forest's distances within ``by``.
    Two clusters that begin to count and become one between two levels are taken for one. Parts of the forest that no chain
    of neighbours links are joined by their shortest bridges, for which blocks of all rows of a group are compared; without ``bridge``
    they stay apart at every level, and their last components end at the last one. With ``epsilon`` no cluster is split below that distance.
    ``find`` finds the neighbours: ``nearest``, or ``nearest_in_buckets`` for large tables. Ids are unique over all groups.
    """
    k = max(min_samples, neighbours or 2 * min_samples)
    near = cut_lineage(find(df, df, k, id, vec, by, metric, skip_same_id=True))
    group = F.col(by) if by else F.lit(0)
    core = near.where(F.col("rank") == min_samples).select(F.col("id"), F.col("distance").alias("_core"), group.alias("_by"))
    rows = cut_lineage(row_index(core, "id", "n"))
    # rows travel as numbers from here on
    side = lambda c, own: rows.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("_core").alias(f"_core_{c}"), *own)
    reach = near.join(side("id", ["_by"]), "id").join(side("neighbour", []), "neighbour")
    edges = reach.select("_by", F.col("n_id").alias("a"), F.col("n_neighbour").alias("b"), F.greatest("distance", "_core_id", "_core_neighbour").alias("w"))
    forest = minimum_forest(edges)
    if bridge:
        vectors = df.select(F.col(id).alias("id"), F.col(vec).alias("vec"))
        forest = bridged(cut_lineage(rows.join(vectors, "id").select("_by", F.col("n").alias("id"), "vec", F.col("_core").alias("core"))), forest, metric)
    placed = cut_lineage(forest.join(rows.select(F.col("n").alias("a"), "_by"), "a"))
    if isinstance(levels, int):
        steps = quantiles(placed, "w", [(i + 1) / levels for i in range(levels)], "_by").select("_by", F.col("quantiles").alias("levels"))
    else:
        steps = rows.select("_by").distinct().withColumn("levels", F.array(*(F.lit(float(x)) for x in sorted(levels))))
    if epsilon is not None:
        steps = steps.withColumn("levels", F.concat(F.array(F.lit(float(epsilon))), F.filter("levels", lambda x: x > epsilon)))
    count = steps.agg(F.max(F.size("levels"))).first()[0] or 1
    # the components of all levels at once: a row has one number per level
    linked = placed.join(steps, "_by").select("a", "b", F.explode(F.filter(F.transform("levels", lambda x, i: F.when(F.col("w") <= x, i)), lambda i: i.isNotNull())).alias("level"))
    own = lambda c: F.col(c) * count + F.col("level")
    components = connected_components(linked.select(own("a").alias("a"), own("b").alias("b")))
    number = lambda c: F.floor(F.col(c) / count)
    members = cut_lineage(components.select(F.pmod("id", F.lit(count)).cast("int").alias("level"), number("id").alias("n"), number("component").alias("component")))
    sizes = members.groupBy("level", "component").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_cluster_size)
    sizes = cut_lineage(sizes)
    # what holds a component of the level below that counts; the others are where a cluster begins
    above = sizes.select((F.col("level") + 1).alias("level"), F.col("component").alias("n")).join(members, ["level", "n"]).select("level", "component").distinct()
    seeds = cut_lineage(sizes.join(above, ["level", "component"], "left_anti").select(F.col("level").alias("start"), F.col("component").alias("n")))
    holding = members.join(seeds, "n").where("level >= start").groupBy("level", "component").agg(F.count(F.lit(1)).alias("seeds"), F.min("n").alias("seed"))
    ends = holding.where("seeds = 1").groupBy("seed").agg(F.max(F.struct("level", "component")).alias("last")).select("last.level", "last.component")
    leaves = ends.join(sizes, ["level", "component"]).join(rows.select(F.col("n").alias("component"), "_by"), "component")
    topics = _numbered(leaves.select("component", "_by", "_size", "level")).join(ends, "component")
    assigned = skew_join(members, topics, ["level", "component"], "inner", members).select("n", "topic")
    named = assigned.join(rows.select("n", F.col("id").alias(id)), "n").select(id, "topic")
    keys = [*([by] if by else []), id]
    return df.select(*keys).join(named, id, "left").select(*keys, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))
