"""Partitioning for stages whose cost is Python work rather than bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of raw images that one task sorts.
IMAGE_BYTES = 256 << 20


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partition count, or ``least`` if that is more.

    A stated count is not coalesced at runtime: small, well compressed shuffles would otherwise be
    merged into a few tasks although every row is expensive to process.
    """
    count = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    return df.repartition(count, *keys)


def image_tasks(images: DataFrame) -> int:
    """Tasks among which images are sorted in bounded memory; reads their sizes, not their pixels."""
    pixels = images.agg(F.sum(F.col("height").cast("long") * F.col("width"))).first()[0] or 0
    return -(-pixels * 3 // IMAGE_BYTES)
