from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeter import sources
from pubmeter.session import cut_lineage, scratch_path

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])


def test_delimited_cells(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('1; padded \n2;NULL\n3;\n4;"""y"""\n5;"a;b"\n', encoding="utf-8")
    back = sources.read_delimited(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert rows(back) == [(1, "padded"), (2, None), (3, None), (4, '"y"'), (5, "a;b")]


def test_no_file_exceeds_the_chunk(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sources.chunked_parquet(spark.range(25).coalesce(1), path, 10)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [5, 10, 10]


def test_row_partitions_are_full(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(1050).select((F.col("id") * 7 % 1051).alias("id"))
    sources.write_row_partitions(df, path, "id", 100)
    sizes = {r["part"]: r["count"] for r in sources.read_row_partitions(spark, path).groupBy("part").count().collect()}
    assert sizes == {**{i: 100 for i in range(1, 11)}, 11: 50}


def test_numbered_files(spark, rows, tmp_path):
    for i in (1, 2, 11):
        spark.range(i).write.parquet(str(tmp_path / f"partition_{i}.parquet"))
    back = sources.read_numbered_files(spark, str(tmp_path))
    assert rows(back.groupBy("part").count()) == [(1, 1), (11, 11), (2, 2)]


def test_report_tables(spark, tmp_path):
    paths = sources.write_tables({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path))
    assert {name: spark.read.parquet(p).count() for name, p in paths.items()} == {"one": 2, "two": 3}


def test_lineage_is_cut_in_the_shared_folder(spark):
    cut = cut_lineage(spark.range(5).withColumn("x", F.lit("a")))
    assert cut.count() == 5 and cut.inputFiles()[0].split(":")[-1].lstrip("/").startswith(scratch_path(spark, "stage").lstrip("/").rsplit("/", 1)[0])
