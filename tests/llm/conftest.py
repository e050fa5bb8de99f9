import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty texts, repeated rows and ids, and columns with names the operators use."""
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (1, "a line that is here\nanother line", "x", 1),
        (1, "a line that is here\nanother line", "x", 1),
        (2, None, "x", 2),
        (3, "", "x", 3),
        (4, " \n\t", "x", 4),
        (None, "a text without an id", "x", 5),
        (5, long, "x", 6),
        (6, long + " end", "x", 7),
        (7, "word", "x", 8),
        (8, "word", "x", 9),
        (8, "another text under the same id", "x", 10),
        (9, "naïve café — übergröße 漢字 😀\nsecond", "x", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, node long")
