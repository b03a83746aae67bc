"""Round trips through the file sources and sinks, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter.operators.counting import frequency, unpivot_all
from pubmeter.plans.matching import first_addresses
from pubmeter.session import scratch_path
from pubmeter.sources import (
    chunked_parquet,
    read_delimited,
    read_numbered_files,
    read_parquet,
    read_row_partitions,
    temp_view,
    write_csv,
    write_parquet,
    write_row_partitions,
    write_tables,
)
from workloads import roles
from workloads.registry import Tables, query
from workloads.roles import prelude


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag", doubles="quantity")
def parquet_folder(t: Tables) -> DataFrame:
    """A query exported to a folder of shards and read back in one scan."""
    path = scratch_path(t.spark, "export")
    write_parquet(t.lineitem.select("l_returnflag", "l_quantity"), path)
    back = read_parquet(t.spark, path)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderkey % 4 + 1 AS part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def numbered_files(t: Tables) -> DataFrame:
    """Numbered partition files read together; the number becomes a column."""
    folder = scratch_path(t.spark, "numbered")
    for i in range(1, 5):
        write_parquet(t.orders.where(F.col("o_orderkey") % 4 + 1 == i).select("o_orderkey", "o_custkey"), f"{folder}/partition_{i}.parquet")
    back = read_numbered_files(t.spark, folder)
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


ODD = """CASE o_orderkey % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN '' WHEN 2 THEN 'has ; and "quotes"' ELSE '  padded  ' END"""


def odd_cells(t: Tables) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    cell = F.when(kind == 0, "NULL").when(kind == 1, "").when(kind == 2, 'has ; and "quotes"').otherwise("  padded  ")
    return t.orders.select(F.col("o_orderkey").alias("id"), cell.alias("cell"))


CELLS = T.StructType([T.StructField("id", T.LongType()), T.StructField("cell", T.StringType())])
CELLS_SQL = f"SELECT o_orderkey AS id, nullif(nullif(trim({ODD}), ''), 'NULL') AS cell FROM orders"


@query(CELLS_SQL)
def delimited_without_header(t: Tables) -> DataFrame:
    """Semicolons, quoted quotes, padding and null tokens."""
    path = scratch_path(t.spark, "delimited")
    write_csv(odd_cells(t), path, ";", header=False)
    return read_delimited(t.spark, path, CELLS)


@query(CELLS_SQL)
def delimited_with_header(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "delimited")
    write_csv(odd_cells(t), path)
    return read_delimited(t.spark, path, CELLS, ",", header=True)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def checked_sample_file(t: Tables) -> DataFrame:
    """Annotated rows written as text and read back with their schema."""
    path = scratch_path(t.spark, "checked")
    write_csv(t.labels, path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    back = read_delimited(t.spark, path, schema, ",", header=True)
    return back.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def chunked_files(t: Tables) -> DataFrame:
    """No file holds more than a thousand rows."""
    path = scratch_path(t.spark, "chunks")
    chunked_parquet(t.events.select("event_id", "event_type"), path, 1_000)
    return read_parquet(t.spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query(
    """SELECT 'priority' AS sheet, o_orderpriority AS item, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL"""
)
def report_tables(t: Tables) -> DataFrame:
    """Several named result tables written side by side."""
    sheets = {name: frequency(t.orders, f"o_order{name}") for name in ("priority", "status")}
    paths = write_tables(sheets, scratch_path(t.spark, "report"))
    first, second = (
        read_parquet(t.spark, path).select(F.lit(name).alias("sheet"), F.col(f"o_order{name}").alias("item"), "n") for name, path in paths.items()
    )
    return first.unionByName(second)


@query(
    """SELECT (event_id_row - 1) // 4000 + 1 AS part, count(*) AS n, min(event_id) AS first, max(event_id) AS last
    FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS event_id_row FROM events) GROUP BY 1"""
)
def row_partition_files(t: Tables) -> DataFrame:
    """Rows in key order cut into parts of equal size, without a single-task sort."""
    path = scratch_path(t.spark, "parts")
    write_row_partitions(t.events.select("event_id", "event_type"), path, "event_id", 4_000)
    back = read_row_partitions(t.spark, path)
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(prelude("address_names") + "SELECT article_id, author_seq, min(address_no) AS address_no FROM address_names GROUP BY ALL")
def named_minimum(t: Tables) -> DataFrame:
    """A grouped minimum kept under a name for later queries."""
    temp_view(first_addresses(roles.address_names(t)), "first_address")
    return t.spark.table("first_address")


LISTED = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS type, count({name}) AS filled FROM documents" for name, kind in LISTED.items()))
def schema_listing(t: Tables) -> DataFrame:
    """Columns of the scanned documents with their types and numbers of values."""
    types = dict(t.documents.dtypes)
    filled = unpivot_all(t.documents.agg(*[F.count(c).alias(c) for c in types]), [], "name", "filled")
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return filled.select("name", F.element_at(names, F.col("name")).alias("type"), "filled")
