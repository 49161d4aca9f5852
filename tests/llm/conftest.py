import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """The small table, for comparison with plain versions."""
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{k % 977}x{k % 31}" for k in range(40000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 3), (4, "One", "en", "b", 3),
        (5, "one", "en", "b", 3), (6, "one two three four", "de", "b", 4), (7, "a b c d e f g h", "de", "c", 9),
        (8, "a b c d e f g h", "de", "c", 9), (9, "A B C D E F G H", None, "c", 9), (10, long_text, "en", "d", 1),
        (11, long_text + " end", "en", "d", 1), (12, "123 !!! ...", "fr", "d", 5), (13, "é ü ñ 漢字   x", "fr", "e", 1),
    ]
    extra = [row + (row[0], "g", "count", 1.5) for row in rows]
    return spark.createDataFrame(extra, SCHEMA + ", component long, g string, `count` string, band double").cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
