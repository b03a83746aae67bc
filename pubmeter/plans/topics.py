"""Topic modelling of a text table: partition, embed, cluster, describe, merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.clustering import MIN_CLUSTER_SIZE, MIN_SAMPLES, density_cluster, density_leaves
from pubmeter.operators.embedding import hashed_embedding, principal_components, principal_components_by
from pubmeter.operators.merging import MIN_SIMILARITY, merge_topics, remap_documents
from pubmeter.functions.vectors import rescale
from pubmeter.operators.tokens import class_tfidf, pooled_centroids, reduce_outliers, rerank_terms, term_counts, top_terms, topic_centroids, topic_info, topic_labels
from pubmeter.session import cut_lineage, discard
from pubmeter.sources.files import row_partitions

MAP_COMPONENTS = 10
# Components of the vectors that are clustered.
CLUSTER_COMPONENTS = 5
# Candidate terms of a topic that are ranked anew by their vectors.
CANDIDATES = 30


@dataclass(frozen=True)
class TopicModel:
    """Result tables of a model: documents, topic vectors, term weights and topic descriptions."""

    documents: DataFrame
    centroids: DataFrame
    weights: DataFrame
    info: DataFrame


def model_topics(
    texts: DataFrame,
    eps: float | None,
    id: str = "id",
    text: str = "title",
    order: str | None = None,
    part_size: int = 500_000,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    min_samples: int = MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    outlier_threshold: float = 0.1,
    min_similarity: float = MIN_SIMILARITY,
    stop: Sequence[str] | None = None,
    components: int | None = CLUSTER_COMPONENTS,
    rerank: bool = False,
    labeller: Callable[[DataFrame], DataFrame] | None = None,
) -> TopicModel:
    """Cluster each part of the table by itself, then merge the parts' topics.

    Clusters are found among the first ``components`` principal components of the part's vectors, rescaled, or among the vectors
    themselves with None. They are those of the density level ``eps``, or with None the leaves of a tree of levels. Topics are described by the whole vectors. With ``rerank`` the leading terms are those whose vectors, from the same
    embedder, lie closest to the topic's. ``labeller`` maps the topic table to (topic, label) for the topics it names.

    All parts go through one plan with a ``part`` column. Any failure is raised. ``embedder`` maps (id, text) to
    (id, vec). ``id`` must be unique; ``order`` names the unique column that places rows in parts.

    ``texts`` is read for its ids, for its vectors and for its terms, so it should be a written table. Only the last of these moves
    texts, and stages of vectors are deleted as soon as what is made of them is written.
    """
    placed = cut_lineage(row_partitions(texts.select(*{id, order or id}), order or id, part_size).select(id, "part"))
    worded = texts.select(id, text)
    vectors = embedder(worded) if embedder else hashed_embedding(worded, id, text)
    embedded = cut_lineage(placed.join(vectors, id))
    if components:
        # read twice, for the spread and to be rescaled
        scores = cut_lineage(principal_components_by(embedded, "vec", components, "part", "low").select(id, "part", "low"))
        placed_vectors, column = cut_lineage(rescale(scores, "low", by="part").select(id, "part", "low")), "low"
    else:
        placed_vectors, column = embedded, "vec"
    if eps is None:
        clustered = density_leaves(placed_vectors, id, column, "part", min_samples, min_cluster_size)
    else:
        clustered = density_cluster(placed_vectors, eps, id, column, "part", min_samples, min_cluster_size)
    doc_topic = cut_lineage(embedded.join(clustered.select(id, "topic"), id))
    found = cut_lineage(topic_centroids(doc_topic.where("topic <> -1"), by="part"))
    assigned = cut_lineage(reduce_outliers(doc_topic, found, outlier_threshold, id, "vec", "part").select(id, "topic"))
    final = cut_lineage(embedded.select(id, "part").join(assigned, id))
    discard(embedded)
    # only outliers have moved, so theirs are the only vectors that meet their topic again
    moved = topic_centroids(doc_topic.where("topic = -1").select(id, "part", "vec").join(assigned, id), by="part")
    means = cut_lineage(pooled_centroids(found.unionByName(moved), by="part"))
    discard(doc_topic)
    mapping, merged = merge_topics(means, min_similarity)
    documents = cut_lineage(remap_documents(final, mapping))
    centroids = merged.withColumnRenamed("merged", "topic")
    weights, info = describe_topics(documents, worded, id, text, stop)
    if rerank:
        info = topic_labels(topic_info(documents, reranked_terms(weights, centroids, embedder)))
    if labeller:
        info = topic_labels(info.drop("label"), labeller(info))
    return TopicModel(documents, centroids, weights, info)


def reranked_terms(weights: DataFrame, centroids: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """``topic, term, similarity, rank``: the heaviest terms of each topic, ranked by closeness to the topic's vector.

    Each distinct term is embedded once, by ``embedder`` over (id, text) or by hashing without weights.
    """
    leading = cut_lineage(top_terms(weights, k=candidates))
    distinct = leading.select(F.col("term").alias("id"), F.col("term").alias("title")).distinct()
    vectors = embedder(distinct) if embedder else hashed_embedding(distinct, "id", "title", weighted=False)
    return rerank_terms(leading, vectors.select(F.col("id").alias("term"), "vec"), centroids)


def describe_topics(
    doc_topic: DataFrame, texts: DataFrame, id: str = "id", text: str = "title", stop: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Term weights and topic descriptions for an assignment; call it again after documents moved."""
    counts = term_counts(doc_topic.select(id, "topic").join(texts.select(id, text), id), "topic", text, stop, uses=True)
    weights = class_tfidf(counts)
    return weights, topic_labels(topic_info(doc_topic, top_terms(weights)))


def document_info(texts: DataFrame, doc_topic: DataFrame, id: str = "id", text: str = "title") -> DataFrame:
    """``id, text, topic`` of every document, without copies."""
    return texts.select(id, text).join(doc_topic.select(id, "topic"), id).distinct()


def topic_map(centroids: DataFrame, components: int = MAP_COMPONENTS) -> DataFrame:
    """``topic, x, y``: topic vectors reduced to ``components`` and then to two dimensions.

    The input is the topic table, and the topic id travels with its row.
    """
    reduced = principal_components(centroids.select("topic", "vec"), "vec", components)
    flat = principal_components(reduced, "vec", 2)
    return flat.select("topic", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
