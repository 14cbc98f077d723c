"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.plans.durable import durable


def smallest_reachable(links: DataFrame, *, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node of a link.

    Every round gives each node the smallest label among its neighbours and itself, then jumps to
    the label of that label; the number of rounds grows with the logarithm of a chain's length.
    Nodes with many links are aggregated before the exchange. Tables are cut with stored files.
    """
    both = durable(
        links.select(F.col(left).alias("node"), F.col(right).alias("other")).union(
            links.select(F.col(right), F.col(left))
        ).distinct()
    )
    labels = durable(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        seen = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        lower = labels.join(seen, "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = durable(
            lower.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old")
            )
        )
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
