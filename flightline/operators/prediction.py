"""Sorting-line crossing, arrival uncertainty and gate probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import INFINITY_EPSILON, project
from ..functions.labels import TERMINAL, gate_label
from ..functions.mathx import erf_values, half_even
from ..settings import FieldOfView, GateLayout, TrackerSettings
from .kernel import BIRTH_VELOCITY_SIGMA

# Floors of the arrival spread and of the crossing speed, and the 95 % quantile.
MINIMUM_X_STD_MM = 0.05
MINIMUM_SPEED_MM_S = 1.0
Z_95 = 1.96
PATH_SAMPLES = 25


def birth_state(
    observations: DataFrame, view: FieldOfView, settings: TrackerSettings | None = None
) -> DataFrame:
    """State and covariance a track starts from, for every observation."""
    s = settings or TrackerSettings()
    drop = F.greatest(
        F.lit(0.0), F.col("y_mm") - F.lit(view.top_y_mm - s.release_height_above_fov_mm)
    )
    first = "confirmed" if s.confirmation_hits <= 1 else "tentative"
    return observations.select(
        "*",
        F.lit(0.0).alias("vx_mm_s"),
        F.sqrt(F.lit(2.0 * s.gravity_mm_s2) * drop).alias("vy_mm_s"),
        F.lit(4.0 * s.measurement_sigma_mm**2).alias("p_pos"),
        F.lit(0.0).alias("p_cross"),
        F.lit(BIRTH_VELOCITY_SIGMA**2).alias("p_vel"),
        F.lit(first).alias("status"),
    )


def propagate(
    states: DataFrame, seconds: Column, settings: TrackerSettings | None = None
) -> DataFrame:
    """Constant-gravity motion with white acceleration noise over ``seconds`` (>= 0)."""
    s = settings or TrackerSettings()
    q = F.lit(s.process_acceleration_sigma_mm_s2**2)
    g = F.lit(s.gravity_mm_s2)
    half = F.lit(0.5) * F.col("_dt") * F.col("_dt")
    dt = F.col("_dt")
    moved = states.withColumn("_dt", seconds).withColumns(
        {
            "x_mm": F.col("x_mm") + F.col("vx_mm_s") * dt,
            "y_mm": F.col("y_mm") + F.col("vy_mm_s") * dt + half * g,
            "vy_mm_s": F.col("vy_mm_s") + g * dt,
            "p_pos": F.col("p_pos") + F.lit(2.0) * dt * F.col("p_cross")
            + dt * dt * F.col("p_vel") + q * half * half,
            "p_cross": F.col("p_cross") + dt * F.col("p_vel") + q * half * dt,
            "p_vel": F.col("p_vel") + q * dt * dt,
        }
    )
    return moved.drop("_dt")


def crossing_time(y: Column, vy: Column, line_y: Column, gravity: float) -> Column:
    """Seconds until the line; 0 once past it, NULL when it is never reached."""
    distance = line_y - y
    if gravity <= 0:
        ahead = F.when(vy > 0, distance / vy)
    else:
        # A positive distance makes the root positive; NaN compares above infinity and drops out.
        ahead = (F.sqrt(vy * vy + F.lit(2.0 * gravity) * distance) - vy) / F.lit(gravity)
    return F.when(distance <= 0, F.lit(0.0)).when(ahead < F.lit(math.inf), ahead)


def crossings(
    snapshots: DataFrame,
    layout: GateLayout,
    settings: TrackerSettings | None = None,
    *,
    line_y: Column | None = None,
) -> DataFrame:
    """Crossing moment and spread for every non-terminal snapshot that reaches the line."""
    live = snapshots.where(~F.col("status").isin(*TERMINAL))
    return _crossed(live, layout, settings, line_y).where(F.col("seconds_until_crossing").isNotNull())


def _crossed(
    snapshots: DataFrame, layout: GateLayout, settings: TrackerSettings | None, line_y: Column | None
) -> DataFrame:
    """Snapshots with their crossing; its values mean nothing where ``seconds_until_crossing`` is null."""
    s = settings or TrackerSettings()
    line = F.lit(float(layout.line_y_mm)) if line_y is None else line_y
    live = snapshots.withColumn("line_y_mm", line).withColumn(
        "seconds_until_crossing", seconds_ahead(F.col, F.col("line_y_mm"), s)
    )
    return live.withColumns(arrival(F.col, F.col("timestamp_ns"), s))


def seconds_ahead(v: Callable[[str], Column], line_y: Column, settings: TrackerSettings) -> Column:
    """Seconds until the line of a snapshot whose values ``v`` gives by name; NULL if terminal or never."""
    ahead = crossing_time(v("y_mm"), v("vy_mm_s"), line_y, settings.gravity_mm_s2)
    return F.when(~v("status").isin(*TERMINAL), ahead)


def arrival(v: Callable[[str], Column], timestamp_ns: Column, settings: TrackerSettings) -> dict[str, Column]:
    """Moment, place and spread of a crossing, from a snapshot with ``seconds_until_crossing``."""
    t = v("seconds_until_crossing")
    drift = F.lit(0.5) * t * t * F.lit(settings.process_acceleration_sigma_mm_s2)
    spread = v("p_pos") + F.lit(2.0) * t * v("p_cross") + t * t * v("p_vel") + drift * drift
    speed = F.greatest(
        F.abs(v("vy_mm_s") + F.lit(settings.gravity_mm_s2) * t), F.lit(MINIMUM_SPEED_MM_S)
    )
    return {
        "crossing_timestamp_ns": timestamp_ns + half_even(t * F.lit(1e9)),
        "x_mean_mm": v("x_mm") + v("vx_mm_s") * t,
        "x_std_mm": F.sqrt(F.greatest(spread, F.lit(MINIMUM_X_STD_MM**2))),
        "time_std_ms": F.lit(1000.0) * F.sqrt(F.greatest(spread, F.lit(0.0))) / speed,
    }


def gate_edges(layout: GateLayout) -> list[float]:
    radius = layout.gate_count // 2
    return [
        layout.centre_x_mm + (index - 0.5) * layout.gate_width_mm
        for index in range(-radius, radius + 2)
    ]


def _gate_chances(mean: np.ndarray, std: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability of every gate, one row per prediction."""
    cdf = 0.5 * (1.0 + erf_values((edges - mean[:, None]) / (std * math.sqrt(2.0))[:, None]))
    return np.clip(np.diff(cdf, axis=1), 0.0, 1.0)


def with_gates(crossed: DataFrame, layout: GateLayout, *, nested: bool = True) -> DataFrame:
    """Gate probabilities, the indices at or above the actuation threshold and the best gate.

    One array computation per batch; ``nested`` adds the whole bank of every row as ``gates``. The
    first of equally probable gates is the best; a row without ``x_mean_mm`` has none.
    """
    edges, radius = np.array(gate_edges(layout)), layout.gate_count // 2
    threshold, count = layout.actuation_probability_threshold, layout.gate_count
    indices = np.arange(-radius, radius + 1, dtype=np.int32)
    added = "selected_gate_indices array<int>, best_gate int, best_probability double"
    if nested:
        added = f"gates array<struct<index:int,left_mm:double,right_mm:double,probability:double>>, {added}"
    schema = T.StructType([*crossed.schema.fields, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            mean, std = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x_mean_mm", "x_std_mm"))
            missing = batch.column("x_mean_mm").is_null().to_numpy(zero_copy_only=False)
            chance = _gate_chances(mean, std, edges)
            chosen = chance >= threshold
            ends = np.concatenate([[0], np.cumsum(chosen.sum(axis=1))]).astype(np.int32)
            best = chance.argmax(axis=1) if rows else np.array([], np.int64)
            columns = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.broadcast_to(indices, chance.shape)[chosen])),
                pa.array(indices[best], mask=missing),
                pa.array(chance[np.arange(rows), best], mask=missing),
            ]
            if nested:
                flat = [np.tile(x, rows) for x in (indices, edges[:-1], edges[1:])]
                bank = pa.StructArray.from_arrays(
                    [pa.array(x) for x in (*flat, chance.ravel())],
                    ["index", "left_mm", "right_mm", "probability"],
                )
                starts = pa.array(np.arange(rows + 1, dtype=np.int32) * count)
                columns.insert(0, pa.ListArray.from_arrays(starts, bank))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return crossed.mapInArrow(run, schema)


def predict(
    snapshots: DataFrame,
    layout: GateLayout,
    settings: TrackerSettings | None = None,
    *,
    line_y: Column | None = None,
    nested: bool = True,
) -> DataFrame:
    return with_gates(crossings(snapshots, layout, settings, line_y=line_y), layout, nested=nested)


def foretell(
    snapshots: DataFrame, layout: GateLayout, settings: TrackerSettings | None = None
) -> DataFrame:
    """All snapshots, each with the best gate and the seconds until its crossing; null where none is predicted."""
    known = F.col("seconds_until_crossing").isNotNull()
    kept = _crossed(snapshots, layout, settings, None).select(
        *snapshots.columns, "seconds_until_crossing", F.when(known, F.col("x_mean_mm")).alias("x_mean_mm"), "x_std_mm"
    )
    return with_gates(kept, layout, nested=False).drop("x_mean_mm", "x_std_mm", "selected_gate_indices")


def gate_indices(layout: GateLayout) -> list[int]:
    radius = layout.gate_count // 2
    return list(range(-radius, radius + 1))


def gate_labels(layout: GateLayout) -> list[str]:
    """What ``gate_label`` says of every gate."""
    return [f"G{i:+d}" if i else "G0" for i in gate_indices(layout)]


def with_chances(frames: DataFrame, layout: GateLayout, crossed: str, name: str) -> DataFrame:
    """Add ``name``: the chances of all gates for every item of the array ``crossed``, NaN without a crossing."""
    edges = np.array(gate_edges(layout))
    added = T.StructField(name, T.ArrayType(T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(crossed)
            items = column.flatten()
            mean, std = (items.field(n).to_numpy(zero_copy_only=False) for n in ("x_mean_mm", "x_std_mm"))
            chances = _lists(_gate_chances(mean.astype(float), std.astype(float), edges))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            nested = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), chances)
            yield pa.RecordBatch.from_arrays([*batch.columns, nested], [*batch.schema.names, name])

    return frames.mapInArrow(run, T.StructType([*frames.schema.fields, added]))


def gate_rows(crossed: DataFrame, layout: GateLayout, keep: list[str]) -> DataFrame:
    """One row per crossing and gate; probabilities come from one array computation per batch."""
    edges, radius = np.array(gate_edges(layout)), layout.gate_count // 2
    narrow = crossed.select(*keep, "x_mean_mm", "x_std_mm")
    kept = [narrow.schema[name] for name in keep]
    schema = T.StructType([*kept, *T.StructType.fromDDL("chances array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = _gate_chances(
                batch.column("x_mean_mm").to_numpy(), batch.column("x_std_mm").to_numpy(), edges
            )
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * layout.gate_count)
            bank = pa.ListArray.from_arrays(starts, pa.array(chance.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], bank], schema.names)

    width, centre = F.lit(layout.gate_width_mm), F.lit(layout.centre_x_mm)
    index = (F.col("_pos") - F.lit(radius)).cast("int")
    return narrow.mapInArrow(run, schema).select(*keep, F.posexplode("chances").alias("_pos", "probability")).select(
        *keep, index.alias("gate_index"),
        (centre + (index - F.lit(0.5)) * width).alias("left_mm"),
        (centre + (index + F.lit(0.5)) * width).alias("right_mm"), "probability",
    )


def _by_key(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row order that brings equal keys together, where each key starts in it, and the keys."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.diff(codes[order], prepend=-1)), coded.dictionary


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def gate_totals(crossed: DataFrame, layout: GateLayout, key: str) -> DataFrame:
    """Predictions, expected arrivals and the highest probability per key (a text, never null) and gate.

    Every batch is summed per key before it leaves its task: what moves is one row per batch and key.
    """
    edges, radius = np.array(gate_edges(layout)), layout.gate_count // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, starts, keys = _by_key(batch.column(key))
            chance = _gate_chances(
                batch.column("x_mean_mm").to_numpy(), batch.column("x_std_mm").to_numpy(), edges
            )[order]
            counts = np.diff(np.append(starts, len(order))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(counts), _lists(np.add.reduceat(chance, starts)), _lists(np.maximum.reduceat(chance, starts))],
                [key, "_n", "_sum", "_max"],
            )

    partial = crossed.select(key, "x_mean_mm", "x_std_mm").mapInArrow(
        run, f"`{key}` string, _n bigint, _sum array<double>, _max array<double>"
    )
    gates = partial.select(key, "_n", F.posexplode(F.arrays_zip("_sum", "_max")).alias("_pos", "_g"))
    return gates.groupBy(key, (F.col("_pos") - F.lit(radius)).cast("int").alias("gate_index")).agg(
        F.sum("_n").alias("predictions"), F.sum("_g._sum").alias("expected"), F.max("_g._max").alias("sharpest")
    )


def with_best_gate(predictions: DataFrame) -> DataFrame:
    """The label of the best gate."""
    return predictions.withColumn("best_label", gate_label(F.col("best_gate")))


def interval_95(crossed: DataFrame, mm_to_px: Column) -> DataFrame:
    """Arrival interval on the line in mm and in pixels."""
    low = F.col("x_mean_mm") - F.lit(Z_95) * F.col("x_std_mm")
    high = F.col("x_mean_mm") + F.lit(Z_95) * F.col("x_std_mm")
    return crossed.withColumns({"low_mm": low, "high_mm": high}).withColumns(
        {
            "low_px": project(mm_to_px, F.col("low_mm"), F.col("line_y_mm")),
            "mean_px": project(mm_to_px, F.col("x_mean_mm"), F.col("line_y_mm")),
            "high_px": project(mm_to_px, F.col("high_mm"), F.col("line_y_mm")),
        }
    )


def flight_path(
    crossed: DataFrame,
    mm_to_px: Column,
    keep: list[str],
    settings: TrackerSettings | None = None,
) -> DataFrame:
    """Pixel samples of the predicted fall, one row each; points at infinity are skipped."""
    s = settings or TrackerSettings()
    samples = crossed.withColumn(
        "sample", F.explode(F.sequence(F.lit(0), F.lit(PATH_SAMPLES - 1)))
    )
    t = F.col("seconds_until_crossing") * (F.col("sample") / F.lit(PATH_SAMPLES - 1.0))
    x = F.col("x_mm") + F.col("vx_mm_s") * t
    y = F.col("y_mm") + F.col("vy_mm_s") * t + F.lit(0.5 * s.gravity_mm_s2) * t * t
    return (
        samples.withColumn("_point", project(mm_to_px, x, y))
        .where(F.col("_point").isNotNull())
        .select(*keep, "sample", F.col("_point.x").alias("x_px"), F.col("_point.y").alias("y_px"))
    )


def mean_paths(
    crossed: DataFrame, mm_to_px: Column, key: str, settings: TrackerSettings | None = None
) -> DataFrame:
    """Mean and lowest pixel of every sample of ``flight_path`` per key (a text, never null).

    Every batch is summed per key before it leaves its task; samples are never rows.
    """
    s = settings or TrackerSettings()
    steps = np.arange(PATH_SAMPLES) / (PATH_SAMPLES - 1.0)
    fall = 0.5 * s.gravity_mm_s2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, starts, keys = _by_key(batch.column(key))
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)[order, None]
            m = [column(f"_m{i}") for i in range(9)]
            t = column("seconds_until_crossing") * steps
            x = column("x_mm") + column("vx_mm_s") * t
            y = column("y_mm") + column("vy_mm_s") * t + fall * t * t
            u, v, w = (m[i] * x + m[i + 1] * y + m[i + 2] for i in (0, 3, 6))
            size = np.abs(w)
            usable = np.isfinite(u) & np.isfinite(v) & np.isfinite(w) & (size >= INFINITY_EPSILON)
            w = np.where(usable, w, 1.0)
            x_px, y_px = np.where(usable, u / w, 0.0), np.where(usable, v / w, 0.0)
            lowest = np.maximum.reduceat(np.where(usable, y_px, -np.inf), starts)
            sums = [np.add.reduceat(a, starts) for a in (usable.astype(np.int64), x_px, y_px)]
            yield pa.RecordBatch.from_arrays(
                [keys, *[_lists(a) for a in (*sums, lowest)]], [key, "_n", "_x", "_y", "_low"]
            )

    wanted = crossed.select(
        key, "seconds_until_crossing", "x_mm", "y_mm", "vx_mm_s", "vy_mm_s",
        *[mm_to_px[i].alias(f"_m{i}") for i in range(9)],
    )
    partial = wanted.mapInArrow(
        run, f"`{key}` string, _n array<bigint>, _x array<double>, _y array<double>, _low array<double>"
    )
    samples = partial.select(key, F.posexplode(F.arrays_zip("_n", "_x", "_y", "_low")).alias("sample", "_s"))
    return (
        samples.groupBy(key, "sample")
        .agg(
            F.sum("_s._n").alias("points"), F.sum("_s._x").alias("_x"), F.sum("_s._y").alias("_y"),
            F.max("_s._low").alias("lowest_px"),
        )
        .where("points > 0")
        .select(
            key, "sample", "points", (F.col("_x") / F.col("points")).alias("x_px"),
            (F.col("_y") / F.col("points")).alias("y_px"), "lowest_px",
        )
    )


def frame_selected_gates(predictions: DataFrame) -> DataFrame:
    """Gates chosen by any track of a frame."""
    return (
        predictions.select("run_id", "frame_index", F.explode("selected_gate_indices").alias("gate"))
        .groupBy("run_id", "frame_index")
        .agg(F.array_sort(F.collect_set("gate")).alias("selected_gates"))
    )
