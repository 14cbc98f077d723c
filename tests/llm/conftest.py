import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

#: Rows with nulls in every column, empty and very long texts, repeated rows and odd characters.
LONG = "lorem ipsum dolor sit amet consectetur " * 4_000
ODD_ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "  \t\n ", "en", "s", 5),
    (4, "one two", "en", None, 7),
    (5, LONG, "en", "s", len(LONG)),
    (6, "Straße ▁ naïve\x00 <|endoftext|> \u00a0 x  y ", "de", "s", 30),
    (6, "Straße ▁ naïve\x00 <|endoftext|> \u00a0 x  y ", "de", "s", 30),
    (None, "a text without an id that is long enough to be looked at", None, "s", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """``ODD_ROWS`` with columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame(ODD_ROWS, SCHEMA)
    for name in ("ids", "score", "kept", "start", "length", "label", "c", "v", "n", "_row", "word", "_text", "offset"):
        table = table.withColumn(name, F.lit("clash"))
    return table


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
