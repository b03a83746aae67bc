"""Session settings, the shared scratch folder and reliable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pubmeter", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a fixed folder serves, but only in local mode, where driver and tasks are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = LOCAL_CHECKPOINTS
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    A lost executor costs no recomputation of it, later reads fetch only the columns they use, and the
    optimizer sees the size of the files instead of an estimate that grows with every join before it. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.options(**options).parquet(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    stage._stage = path
    return stage


def discard(*stages: DataFrame) -> None:
    """Deletes the files of results of :func:`cut_lineage` that nothing reads any more: all made of them is written itself."""
    for stage in stages:
        context = stage.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stage._stage)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
