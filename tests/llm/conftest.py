from __future__ import annotations

import pytest

from riskloom.session import configure

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 701}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows."""
    return [
        (1, "The plain text of the first row, in English words.", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (None, "A text without an id and the usual words of it.", "en", "b", 3),
        (5, LONG, None, "b", len(LONG)),
        (6, "The plain text of the first row, in English words.", "en", "a", 10),
        (6, "The plain text of the first row, in English words.", "en", "a", 10),
        (7, " \n\t \n", "de", "c", 5),
        (8, "12345 !!! 678", "de", "c", 13),
        (9, "Der schnelle Fuchs und die faule Katze sind nicht auf dem Dach.", "de", "c", 1),
        (10, "double  space and \n space before break \r\n end ", None, None, None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    configure(spark)
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return configure(spark).createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd documents with further columns named like results."""
    names = ["kept", "score", "shard", "slot", "piece", "start", "block", "copy", "component_id", "removed", "line", "key", "node"]
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])
