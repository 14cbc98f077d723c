"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the word rule: white space is U+0020 and U+0009 to U+000D, letters fold A-Z only.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column) -> Column:
    """Words of a text as an array, empty for null; a word is a maximal run without white space."""
    parts = F.split(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


