"""Nearest neighbours at scale: tables of random hyperplanes, buckets split until they are small, exact distances within.

In each table a vector's signature is the sides of a sequence of hyperplanes on which it lies, and its bucket the shortest
beginning of the signature that it shares with few enough vectors. Vectors that point in like directions share a bucket
of some table with high probability. Every vector is copied once per table, however many rows there are, and is compared
with one bucket of bounded size in each; a bucket of vectors that no hyperplane tells apart is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeter.operators.neighbours import DIGITS, best_in_cells
from pubmeter.operators.ordering import first_rows
from pubmeter.session import cut_lineage

TABLES = 16
# Hyperplanes of a table, and vectors that a bucket may hold.
BITS = 48
LIMIT = 2_048
# Fixed values of the rule that draws the hyperplanes: a prime modulus and a shift.
MODULUS = 2_147_483_647
SHIFT = 12_345


def hyperplanes(tables: int, bits: int, size: int) -> np.ndarray:
    """Normals of ``tables`` times ``bits`` hyperplanes, components plus or minus one, by three rounds of squaring modulo a prime."""
    plane = np.arange(tables * bits, dtype=np.int64)
    x = (plane[:, None] << 20) + np.arange(1, size + 1, dtype=np.int64)
    for _ in range(3):
        x = (x % MODULUS * (x % MODULUS) + SHIFT) % MODULUS
    return np.where(x > MODULUS // 2, 1.0, -1.0)


def signatures(df: DataFrame, id: str, vec: str, tables: int = TABLES, bits: int = BITS, by: str | None = None) -> DataFrame:
    """``_by, id, table, signature``: one row per vector and table; the first hyperplane gives the highest bit."""
    rows = df.select((F.col(by) if by else F.lit(0)).alias("_by"), F.col(id).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vec"))
    types = dict(rows.dtypes)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.stack(batch.column(2).to_numpy(zero_copy_only=False))
            if normals.shape[1] != vectors.shape[1]:
                normals = hyperplanes(tables, bits, vectors.shape[1])
            sides = np.round(vectors @ normals.T, DIGITS) >= 0
            found = sides.reshape(len(vectors), tables, bits) @ weights
            place = pa.array(np.repeat(np.arange(len(vectors)), tables))
            columns = [batch.column(0).take(place), batch.column(1).take(place), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(vectors))), pa.array(found.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["_by", "id", "table", "signature"])

    return rows.where("vec IS NOT NULL").mapInArrow(sign, f"_by {types['_by']}, id {types['id']}, table int, signature bigint")


def default_depths(rows: int, limit: int = LIMIT, bits: int = BITS) -> list[int]:
    """Lengths of signature beginnings that are tried: the length that would do for evenly filled buckets, then longer ones."""
    first = min(bits, max(0, (rows // limit).bit_length()))
    steps = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32]
    return sorted({min(bits, first + s) for s in steps} | {bits})


def leaves(signed: DataFrame, depths: Sequence[int], limit: int = LIMIT, bits: int = BITS) -> DataFrame:
    """``_by, table, depth, beginning, rows``: the buckets, each the shortest beginning that at most ``limit`` rows share.

    Buckets that are too large go on to the next length, and with the last length they stay as large as they are. Each round
    reads only what is left.
    """
    left, out = signed, None
    for place, depth in enumerate(depths):
        counted = cut_lineage(left.groupBy("_by", "table", beginning(depth, bits).alias("beginning")).agg(F.count(F.lit(1)).alias("rows")))
        done = counted if place == len(depths) - 1 else counted.where(F.col("rows") <= limit)
        settled = done.select("_by", "table", F.lit(depth).alias("depth"), "beginning", "rows")
        out = settled if out is None else out.unionByName(settled)
        large = counted.where(F.col("rows") > limit).select("_by", "table", "beginning")
        if place == len(depths) - 1 or large.isEmpty():
            break
        # the few large buckets' signatures alone go on
        left = cut_lineage(left.withColumn("beginning", beginning(depth, bits)).join(large, ["_by", "table", "beginning"], "left_semi").drop("beginning"))
    return cut_lineage(out)


def beginning(depth: int, bits: int) -> Column:
    return F.shiftright("signature", bits - depth)


def nearest_in_buckets(
    left: DataFrame,
    right: DataFrame,
    k: int,
    id: str = "id",
    vec: str = "vec",
    by: str | None = None,
    metric: str = "cosine",
    skip_same_id: bool = False,
    tables: int = TABLES,
    limit: int = LIMIT,
    bits: int = BITS,
    depths: Sequence[int] | None = None,
) -> DataFrame:
    """The ``k`` nearest of the right rows that share a bucket with the left row: ``id, neighbour, distance, rank`` (and ``by``).

    Distances are exact, and equal ones go to the smaller id; a true neighbour is missed if it shares no bucket, which gets
    rarer with more ``tables`` and larger ``limit``. Buckets are those of the right rows. Ids are unique on each side; rows
    without a vector take no part. Hyperplanes pass through the origin, so buckets are good for angles, and for Euclidean distances
    of centred vectors.
    """
    signed_right = cut_lineage(signatures(right, id, vec, tables, bits, by))
    signed_left = signed_right if left is right else cut_lineage(signatures(left, id, vec, tables, bits, by))
    depths = list(depths) if depths is not None else default_depths(right.count(), limit, bits)
    found = leaves(signed_right, depths, limit, bits)
    options = F.array(*(F.struct(F.lit(d).alias("depth"), beginning(d, bits).alias("beginning")) for d in depths))

    def placed(signed: DataFrame) -> DataFrame:
        tried = signed.select("_by", "id", "table", F.explode(options).alias("o")).select("_by", "id", "table", "o.depth", "o.beginning")
        met = tried.join(found, ["_by", "table", "depth", "beginning"])
        return met.select("id", F.xxhash64("_by", "table", "depth", "beginning").alias("_bucket"))

    rights = cut_lineage(placed(signed_right))
    lefts = rights if left is right else cut_lineage(placed(signed_left))
    count = lambda rows, name: rows.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias(name))
    counts = cut_lineage(count(lefts, "_nl").join(count(rights, "_nr"), "_bucket"))

    def cells(rows: DataFrame, source: DataFrame) -> DataFrame:
        held = rows.join(counts, "_bucket").join(source.select(F.col(id).alias("id"), F.col(vec).alias("vec")), "id")
        return held.select(F.col("_bucket").alias("_by"), *(F.col(c).alias(c) for c in ("id", "vec", "_nl", "_nr")))

    near = best_in_cells(cells(lefts, left), cells(rights, right), k, metric, skip_same_id)
    once = near.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    ranked = first_rows(once, ["id"], [F.asc("distance"), F.asc("neighbour")], k, "rank")
    return ranked.join(left.select(F.col(id).alias("id"), by), "id") if by else ranked
