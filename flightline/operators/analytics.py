"""Run-level summaries: latency, progress, prefixes and settings compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import half_even


def latency_summary(frames: DataFrame, keys: list[str], value: str = "processing_ms") -> DataFrame:
    """Mean and nearest-rank 95th percentile (an actual element, half-even index).

    Values are first counted per distinct latency, so a run with very many frames is ranked over
    its distinct values instead of being collected.
    """
    counted = frames.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn(
        "_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.least(F.col("_total") - 1, half_even((F.col("_total") - 1) * F.lit(0.95)))
    return ranked.groupBy(*keys).agg(
        F.max("_total").alias("frames"),
        (F.sum(F.col(value) * F.col("_n")) / F.max("_total")).alias("mean_ms"),
        F.min(F.when(F.col("_upto") > wanted, F.col(value))).alias("p95_ms"),
    )


def with_empty_runs(summary: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs without frames report zero latency."""
    return runs.select(*keys).join(summary, keys, "left").select(
        *keys,
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("frames", "mean_ms", "p95_ms")],
    )


def prefix_run(timeline: DataFrame, frames: int) -> DataFrame:
    """The first ``frames`` frames of every run: a stopped analysis is a filtered one."""
    return timeline.where(F.col("frame_index") < frames)


def progress(done: DataFrame, timeline: DataFrame, every: int = 10) -> DataFrame:
    """Frames done out of all, and the last reported multiple of ``every``."""
    total = timeline.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    so_far = done.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    return total.join(so_far, "run_id", "left").select(
        "run_id",
        F.coalesce("done", F.lit(0)).alias("done"),
        "total",
        (F.floor(F.coalesce("done", F.lit(0)) / every) * every).cast("bigint").alias("reported"),
    )


class MixedSettings(ValueError):
    """Results made under different settings cannot be combined."""


def tag_settings(df: DataFrame, *settings) -> DataFrame:
    """Stamp outputs with the settings they depend on."""
    return df.withColumn("settings_hash", F.lit("-".join(s.settings_hash for s in settings)))


def union_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union that refuses outputs of different settings, checked by one tiny aggregate."""
    both = left.unionByName(right)
    seen = both.agg(F.min("settings_hash").alias("a"), F.max("settings_hash").alias("b")).first()
    if seen.a != seen.b:
        raise MixedSettings("results were computed under different settings")
    return both
