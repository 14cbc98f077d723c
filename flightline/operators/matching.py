"""Match costs of neighbouring frames as a gated theta join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import TrackerSettings
from .assignment import UNMATCHED_COST
from .prediction import propagate


def candidate_costs(
    states: DataFrame, detections: DataFrame, settings: TrackerSettings | None = None,
    *, placed_by: Sequence[str] = (),
) -> DataFrame:
    """Gated pairs of ``states`` (moved to the frame time) with that frame's ``detections``.

    ``states`` carry ``match_frame`` and ``match_timestamp_ns``, the frame they are matched in. The
    join is an equality on run and frame; the gate then prunes within one image. ``placed_by`` names
    columns of both sides that are equal for a frame and its states: sides that are already dealt out
    by the run and these are joined where they are.
    """
    s = settings or TrackerSettings()
    seconds = (F.col("match_timestamp_ns") - F.col("timestamp_ns")) / F.lit(1e9)
    moved = propagate(states, seconds, s).select(
        "run_id", *placed_by,
        F.col("match_frame").alias("frame_index"),
        F.col("det_ord").cast("bigint").alias("track"),
        F.col("x_mm").alias("_px"),
        F.col("y_mm").alias("_py"),
        (F.col("p_pos") + F.lit(s.measurement_sigma_mm**2)).alias("_var"),
        F.col("area_px").alias("_area"),
    )
    seen = detections.select(
        "run_id", *placed_by, "frame_index", F.col("det_ord").cast("bigint").alias("detection"),
        "x_mm", "y_mm", "area_px",
    )
    return _gated(moved.join(seen, ["run_id", *placed_by, "frame_index"]), s)


def neighbour_costs(
    states: DataFrame, settings: TrackerSettings | None = None, *, placed_by: Sequence[str] = ()
) -> DataFrame:
    """``candidate_costs`` between every frame and the one before it, where both already are.

    ``states`` are the states that detections would begin, with ``match_timestamp_ns`` of the next frame. They
    are dealt out by the run and ``placed_by``; a frame meets the frame before it if that is in the same place.
    A frame's detections are gathered in one row, so nothing is moved.
    """
    s = settings or TrackerSettings()
    seconds = (F.col("match_timestamp_ns") - F.col("timestamp_ns")) / F.lit(1e9)
    seen = states.withColumns({"_x": F.col("x_mm"), "_y": F.col("y_mm")})
    item = F.struct(
        F.col("det_ord").cast("bigint").alias("no"), F.col("_x").alias("x"), F.col("_y").alias("y"), "area_px",
        F.col("x_mm").alias("px"), F.col("y_mm").alias("py"),
        (F.col("p_pos") + F.lit(s.measurement_sigma_mm**2)).alias("var"),
    )
    frames = propagate(seen, seconds, s).groupBy("run_id", *placed_by, "frame_index").agg(
        F.collect_list(item).alias("_now")
    )
    order = Window.partitionBy("run_id", *placed_by).orderBy("frame_index")
    follows = F.lag("frame_index").over(order) == F.col("frame_index") - 1
    paired = frames.withColumn("_before", F.when(follows, F.lag("_now").over(order))).where("_before IS NOT NULL")
    pairs = paired.select("run_id", "frame_index", "_now", F.explode("_before").alias("b")).select(
        "run_id", "frame_index", "b", F.explode("_now").alias("n")
    )
    flat = pairs.select(
        "run_id", "frame_index", F.col("b.no").alias("track"), F.col("b.px").alias("_px"), F.col("b.py").alias("_py"),
        F.col("b.var").alias("_var"), F.col("b.area_px").alias("_area"), F.col("n.no").alias("detection"),
        F.col("n.x").alias("x_mm"), F.col("n.y").alias("y_mm"), F.col("n.area_px").alias("area_px"),
    )
    return _gated(flat, s)


def _gated(pairs: DataFrame, s: TrackerSettings) -> DataFrame:
    rx, ry = F.col("x_mm") - F.col("_px"), F.col("y_mm") - F.col("_py")
    gate = F.lit(s.association_gate_sigma**2)
    ratio = F.greatest(F.col("area_px"), F.lit(1)) / F.greatest(F.col("_area"), F.lit(1))
    return (
        pairs.withColumn("_d2", (rx * rx + ry * ry) / F.col("_var"))
        .where(F.col("_d2") <= gate)
        .withColumn("cost", F.col("_d2") / gate + F.abs(F.log(ratio)) * F.lit(s.appearance_weight))
        .where(F.col("cost") < UNMATCHED_COST)
        .select("run_id", "frame_index", "track", "detection", "cost")
    )
