"""Text vectors: a JVM-side hashed default and any batch encoder through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeter.functions.text import tokens
from pubmeter.session import cut_lineage

# Groups whose sums a task holds before it hands them on.
GROUPS_HELD = 32
# Vectors that a task holds for want of enough of their group, and tasks whose vectors of a group meet in one.
LOOSE_HELD, TASKS_MET = 16_384, 256
Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, id: str, text: str, load_encoder: Callable[[], Encoder]) -> DataFrame:
    """``id, vec`` from an encoder that each task loads once and feeds batch by batch."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text].tolist()), dtype=np.float32)
            yield pd.DataFrame({id: batch[id], "vec": list(vectors)})

    return df.select(id, text).mapInPandas(encode, f"{id} {dict(df.dtypes)[id]}, vec array<float>")


def hashed_embedding(df: DataFrame, id: str, text: str, size: int = 256, weighted: bool = True) -> DataFrame:
    """``id, vec``: hashed word and word-pair counts of unit length, by default weighted by rarity."""
    words = df.select(id, tokens(F.col(text)).alias("_words"))
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(words)
    terms = pairs.withColumn("_terms", F.concat("_words", "_pairs"))
    counted = HashingTF(numFeatures=size, inputCol="_terms", outputCol="_tf").transform(terms)
    if weighted:
        # read twice, by the fit and by its use
        counted = cut_lineage(counted.select(id, "_tf"))
        counted = IDF(inputCol="_tf", outputCol="_raw").fit(counted).transform(counted)
    else:
        counted = counted.withColumnRenamed("_tf", "_raw")
    scaled = Normalizer(inputCol="_raw", outputCol="_unit").transform(counted)
    return scaled.select(id, vector_to_array("_unit", "float32").alias("vec"))


def principal_components(df: DataFrame, vec: str, k: int, output: str | None = None) -> DataFrame:
    """Scores on the first ``k`` principal components of the centred vectors.

    The sign of each component is set so that its largest loading is positive.
    """
    data = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    # The loadings are a matrix of vector length by k, whatever the number of rows.
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    scores = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b)
    return model.transform(centred).withColumn(output or vec, scores).drop("_v", "_c", "_p")


def principal_components_by(df: DataFrame, vec: str, k: int, by: str, output: str | None = None) -> DataFrame:
    """Scores on the first ``k`` principal components of the vectors of each ``by``, centred and fitted by itself.

    Map tasks sum vectors and products of components per group, one row per component, where that is less than the vectors themselves:
    a task that holds no more rows of a group than vectors have components hands these on. The sums are added by group and
    component, and a group's small covariance matrix is decomposed where its rows meet. What meets there depends on the vector
    length and not on the rows; what is shuffled is never more than the vectors. The sign of each component is set so that its largest loading is positive. Vectors of a group
    are equally long, with at least ``k`` components; rows without a vector keep a missing one.
    """
    source = df.where(F.col(vec).isNotNull()).select(F.col(by).alias("by"), F.col(vec).alias("vec"))
    by_type, vec_type = (dict(source.dtypes)[c] for c in ("by", "vec"))
    names = ["by", "place", "n", "total", "products"]
    sums_schema = f"by {by_type}, place int, n bigint, total double, products array<double>"
    types = [batch_type(by_type), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the vectors of a task's groups, and their sums where there are more of them than components
        loose: dict = {}
        held: dict = {}
        count = 0
        for batch in batches:
            groups = batch.column(0).dictionary_encode(null_encoding="encode")
            vectors = batch.column(1).to_numpy(zero_copy_only=False)
            of = groups.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1], True])
            for rows in (order[a:b] for a, b in zip(edges, edges[1:])):
                group = groups.dictionary[int(of[rows[0]])].as_py()
                block = np.stack(vectors[rows])
                loose.setdefault(group, []).append(block)
                count += len(block)
                if group in held or sum(map(len, loose[group])) > block.shape[1]:
                    count -= sum(map(len, loose[group]))
                    held[group] = summed(np.concatenate(loose.pop(group)), held.get(group))
            if len(held) > GROUPS_HELD:
                yield sums(held)
                held = {}
            if count > LOOSE_HELD:
                yield from rows_of(loose)
                loose, count = {}, 0
        if held:
            yield sums(held)
        yield from rows_of(loose)

    def summed(block: np.ndarray, before: tuple | None) -> tuple:
        n, total, products = before or (0, 0.0, 0.0)
        block = block.astype(np.float64)
        return n + len(block), total + block.sum(axis=0), products + block.T @ block

    def sums(held: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for group, (n, total, products) in held.items():
            for place in range(len(total)):
                for to, x in zip(columns, (group, place, n, float(total[place]), products[place])):
                    to.append(x)
        arrays = [*(pa.array(c, t) for c, t in zip(columns, types)), pa.nulls(len(columns[0]), vector)]
        return pa.RecordBatch.from_arrays(arrays, [*names, "vec"])

    def rows_of(loose: dict) -> Iterator[pa.RecordBatch]:
        """Vectors as they are, at a place before the first; those of many tasks at several."""
        place = -1 - TaskContext.get().partitionId() // TASKS_MET
        for group, blocks in loose.items():
            block = list(np.concatenate(blocks))
            whole = [pa.array([x] * len(block), t) for x, t in zip((group, place), types)]
            yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(len(block), t) for t in types[2:]), pa.array(block, vector)], [*names, "vec"])

    def merge(table: pa.Table) -> pa.Table:
        if table["place"][0].as_py() < 0:
            return pa.Table.from_batches([sums({table["by"][0].as_py(): summed(np.stack(table["vec"].to_numpy()), None)})]).select(names)
        products = np.sum(np.stack(table["products"].to_numpy()), axis=0)
        row = [table["by"][:1].combine_chunks(), table["place"][:1].combine_chunks(), pa.array([sum(table["n"].to_pylist())]), pa.array([float(np.sum(table["total"].to_numpy()))])]
        return pa.Table.from_arrays([*row, pa.array([products], pa.list_(pa.float64()))], names)

    def fit(table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        n = int(table["n"].to_numpy()[place == 0].sum())
        total = np.zeros(place.max() + 1)
        np.add.at(total, place, table["total"].to_numpy())
        products = np.zeros((len(total), len(total)))
        np.add.at(products, place, np.stack(table["products"].to_numpy()))
        mean = total / n
        covariance = products / n - np.outer(mean, mean)
        _, axes = np.linalg.eigh(covariance)
        loadings = axes[:, ::-1][:, :k].T
        loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
        columns = [table["by"][:1].combine_chunks(), pa.array([mean], pa.list_(pa.float64())), pa.array([list(loadings)], pa.list_(pa.list_(pa.float64())))]
        return pa.Table.from_arrays(columns, ["by", "mean", "loadings"])

    vector = pa.list_(pa.float32() if vec_type == "array<float>" else pa.float64())
    if vec_type != "array<float>":
        source = source.select("by", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    carried = "array<float>" if vec_type == "array<float>" else "array<double>"
    partial = source.mapInArrow(add, f"{sums_schema}, vec {carried}")
    summed = partial.groupBy("by", "place").applyInArrow(merge, sums_schema)
    fitted = cut_lineage(summed.groupBy("by").applyInArrow(fit, f"by {by_type}, mean array<double>, loadings array<array<double>>"))
    # one row per group, which the optimizer broadcasts where it is small enough
    joined = df.join(fitted.withColumnsRenamed({"by": "_by", "mean": "_mean", "loadings": "_loadings"}), F.col(by).eqNullSafe(F.col("_by")), "left")
    centred = F.zip_with(F.transform(vec, lambda x: x.cast("double")), "_mean", lambda x, m: x - m)
    score = lambda axis: F.aggregate(F.zip_with("_centred", axis, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)
    scored = joined.withColumn("_centred", centred).withColumn(output or vec, F.when(F.col(vec).isNotNull(), F.transform("_loadings", score)))
    return scored.drop("_by", "_mean", "_loadings", "_centred")


def batch_type(name: str) -> pa.DataType:
    """The Arrow type of a column of whole numbers or text."""
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[name]
