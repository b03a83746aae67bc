from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import pubmeter  # noqa: E402

cloudpickle.register_pickle_by_value(pubmeter)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a result as a sorted list of tuples, nulls first."""

    def collect(df, *columns):
        picked = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(picked, key=lambda r: [(v is not None, str(v)) for v in r])

    return collect
