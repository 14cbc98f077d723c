"""Filter trajectories whose identity is already known (hand labels, simulations)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.spread import spread
from ..settings import FieldOfView, TrackerSettings
from .kernel import FrameTracker

_COLUMNS = ("run_id", "label", "frame_index", "timestamp_ns", "x_mm", "y_mm", "area_px")
_RESULT = [
    ("run_id", pa.string()), ("label", pa.int64()), ("frame_index", pa.int64()),
    ("timestamp_ns", pa.int64()), ("x_mm", pa.float64()), ("y_mm", pa.float64()),
    ("vx_mm_s", pa.float64()), ("vy_mm_s", pa.float64()), ("p_pos", pa.float64()),
    ("p_cross", pa.float64()), ("p_vel", pa.float64()), ("hits", pa.int32()),
    ("status", pa.string()),
]
_SCHEMA = (
    "run_id string, label bigint, frame_index bigint, timestamp_ns bigint, x_mm double, "
    "y_mm double, vx_mm_s double, vy_mm_s double, p_pos double, p_cross double, p_vel double, "
    "hits int, status string"
)


def filter_labelled(
    labelled: DataFrame, view: FieldOfView, settings: TrackerSettings | None = None
) -> DataFrame:
    """Filtered state after every observation of each ``(run_id, label)`` trajectory."""
    settings = settings or TrackerSettings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = FrameTracker(settings, view.top_y_mm, view.bottom_y_mm)
        key = flight = None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(name).to_pylist() for name in _COLUMNS]):
                run_id, label, frame, ts, x, y, area = row
                detection = (1, x, y, (0, 0, 0, 0), area, None)
                if (run_id, label) != key:
                    key = (run_id, label)
                    flight = rules._birth(frame, ts, detection)
                else:
                    rules._advance(flight, ts)
                    rules._absorb(flight, detection)
                out.append(
                    (
                        run_id, label, frame, ts, flight.x, flight.y, flight.vx, flight.vy,
                        flight.p_pos, flight.p_cross, flight.p_vel, flight.hits, flight.status,
                    )
                )
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, (_, kind) in zip(zip(*out), _RESULT)],
                    names=[name for name, _ in _RESULT],
                )

    return (
        spread(labelled.select(*_COLUMNS), "run_id", "label")
        .sortWithinPartitions("run_id", "label", "frame_index")
        .mapInArrow(run, _SCHEMA)
    )
