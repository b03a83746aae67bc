from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def stages(spark, tmp_path_factory):
    """A folder for intermediate results, where the session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("stages")))


# Texts with what may go wrong: missing, empty, blank, equal, long, other scripts, repeated ids, a missing id.
ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one two three four five six seven eight nine ten eleven twelve"),
    (4, "one  two\tthree four five six seven eight nine ten eleven twelve"),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "word " * 30_000),
    (6, "Ünïcode 漢字 текст  end <|endoftext|> it's don't"),
    (7, "x"),
    (7, "x"),
    (None, "x"),
    (8, "A line that many sites share here.\nown line\n\nA line that many sites share here."),
]


@pytest.fixture
def odd(spark):
    """Odd texts with further columns whose names operators use themselves."""
    rows = [(i, t, "en", f"src{k % 6}", len(t or ""), k, "key", 1.0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double")


@pytest.fixture
def none(odd):
    return odd.where("doc_id > 100")
