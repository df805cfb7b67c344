import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, ties, and a clashing extra column."""
    long = " ".join(f"w{i} x{i % 7}" for i in range(30_000))
    return spark.createDataFrame([
        (1, None, "a", "z"), (2, "", "a", None), (3, "   \n \t", None, "z"), (4, "one two", "b", "z"), (4, "one two", "b", "z"),
        (None, "one two", "b", "z"), (None, None, None, None), (5, long, "a", "z"), (6, long, "a", "z"), (7, "é ü\n" * 90, "c", "z")], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def table(spark, name, sf=SF):
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
