import pytest
from pyspark.sql import functions as F

CLASHING = ["fp", "row_no", "start", "word", "size", "place", "score", "ids", "segment", "n", "starts", "copies", "rank", "_key", "_id"]
COPY = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals in the old forest tonight"


def tricky_rows():
    """Null ids, texts and sources, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [
        (0, COPY, "en", "a", 3), (1, COPY, "en", "a", 3), (2, COPY.upper(), "en", None, 3), (3, None, None, "b", None), (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 4), (6, long, "en", "c", 9), (7, f"Intro words here. {COPY}\nAnd an end", "de", "c", 5), (8, "one", "en", None, 3),
        (9, "one two", "en", "a", 7), (10, "Straße é日本 \U0001f600  two  spaces ", "de", "a", 7), (11, "same " * 60, "en", "b", 1),
        (12, COPY + " " + COPY, "fr", "c", 1), (13, "word", "en", "", 1), (14, "x" * 3000, "en", "a", 1),
    ]
    rows += [(7, f"Intro words here. {COPY}\nAnd an end", "de", "c", 5), (None, "lost and found", "en", "a", 2), (None, COPY, "en", "b", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tricky(spark):
    df = spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
