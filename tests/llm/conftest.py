import os
import re

import pytest

SF = "/root/testdata/sf0.01"
SF_TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    copy = " ".join(f"copy{i}" for i in range(60))
    rows = [(1, copy, "en", "a", 1), (2, copy, "en", "a", 1), (2, copy, "en", "a", 1), (3, copy + " tail of its own", None, None, None),
            (4, None, "en", "a", None), (5, "", "fr", "b", 0), (6, " \t\n\r ", "fr", "b", 5), (None, copy, "en", "a", 1),
            (None, None, None, None, None), (7, long_text, "de", "c", 9), (8, "one two three", "de", "c", 9),
            (9, "na " * 300, "es", None, 900), (10, "ab cd " * 200 + "z", "es", "a", 1200), (11, "Été naïve \U0001f600 中文", "fr", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, name, sf=SF_TINY):
    path = f"{sf}/{name}.parquet"
    assert os.path.exists(path)
    return spark.read.parquet(path)
