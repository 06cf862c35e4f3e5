import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, n_words int, kept string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    a = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, a, "en", "s1"), (2, a + " tail", "en", "s1"), (3, a, None, None), (3, a, None, None), (None, a.upper(), "en", "s2"),
        (5, "", "en", "s1"), (6, None, None, "s2"), (7, "one two", "en", "s2"), (8, "ONE  two", "en", "s2"), (9, "12 34 !!", "en", "s2"),
        (10, "lang " * 30_000, "en", "s1"), (11, "ünï çødé \u00a0 日本 " * 40, "fr", "s1"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "k", 2, "x") for r in rows], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
