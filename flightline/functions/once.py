"""Keeping expensive expressions from being evaluated several times per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions later filters and projections cannot inline.

    The optimizer pushes a filter through a projection by copying its expressions, which would
    parse the same JSON text many times. Output of a generator is never copied.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = df.select("*", F.explode_outer(F.array(packed)).alias("_once"))
    return kept.select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns])
