import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1])]

#: Ids repeat, texts are null, empty, white space, equal, long; a column has the name of one that is made.
ROWS = [
    (1, "one two three four five six", "en", "b", 1),
    (2, "one  two three\tfour five six", "en", "b", 2),
    (3, "", "en", None, 3),
    (4, None, None, None, None),
    (5, " \n ", "fr", "", 5),
    (6, "x" * 30_000, "de", "a", 6),
    (7, "word " * 20_000, "de", "a", 7),
    (7, "word " * 20_000, "de", "a", 7),
    (None, "one two three four five six", "en", "c", 9),
    (8, "é😀 Σ " * 50 + "\n\nlast paragraph.", "es", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
