"""Tracker as a Structured Streaming operator with the same frame kernel as the batch job."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.kernel import Flight, FrameTracker
from ..operators.segments import DETECTION_FIELDS, DETECTION_ORDER
from ..operators.tracking import EDGE_REASONS, touched_margins
from ..settings import FieldOfView, TrackerSettings

FRAME_SCHEMA = (
    "run_id string, frame_index bigint, timestamp_ns bigint, detections array<struct<x_mm:double,"
    "y_mm:double,cx_px:double,cy_px:double,bbox_x:int,bbox_y:int,bbox_w:int,bbox_h:int,"
    "area_px:bigint>>"
)
_OUT = [
    ("run_id", "string"), ("row_kind", "string"), ("frame_index", "bigint"),
    ("timestamp_ns", "bigint"), ("sequence", "bigint"), ("status", "string"), ("x_mm", "double"),
    ("y_mm", "double"), ("vx_mm_s", "double"), ("vy_mm_s", "double"), ("p_pos", "double"),
    ("p_cross", "double"), ("p_vel", "double"), ("hits", "int"), ("misses", "int"),
    ("det_ord", "int"), ("detail", "string"),
]
OUTPUT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _OUT)
_NAMES = [name for name, _ in _OUT]


class FlightTracker(StatefulProcessor):
    """State per run: live and hidden flights, the next bean sequence and the last frame."""

    def __init__(self, settings: TrackerSettings, view: FieldOfView):
        self.settings, self.view = settings, view

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "payload string")

    def _load(self):
        tracker = FrameTracker(self.settings, self.view.top_y_mm, self.view.bottom_y_mm)
        numbers, last, born = {}, -1, 0
        if self.state.exists():
            saved = json.loads(self.state.get()[0])
            tracker.active = [Flight.restore(v) for v in saved["active"]]
            tracker.hidden = [Flight.restore(v) for v in saved["hidden"]]
            numbers = {tuple(k): v for k, v in saved["numbers"]}
            last, born = saved["last"], saved["born"]
        return tracker, numbers, last, born

    def _save(self, tracker, numbers, last, born) -> None:
        live = {flight.birth for flight in tracker.active}
        payload = {
            "active": [f.values() for f in tracker.active],
            "hidden": [f.values() for f in tracker.hidden],
            "numbers": [[list(k), v] for k, v in numbers.items() if k in live],
            "last": last, "born": born,
        }
        self.state.update((json.dumps(payload),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802,N803
        tracker, numbers, last, born = self._load()
        frames = sorted(
            ((int(f), int(t), list(d)) for part in rows for f, t, d in zip(
                part["frame_index"], part["timestamp_ns"], part["detections"])),
            key=lambda item: item[0],
        )
        out = []
        blank = (None,) * 12
        for frame, ts, found in frames:
            if frame <= last:
                out.append((key[0], "late", frame, ts, *blank, "frame already processed"))
                continue
            last = frame
            detections = []
            for position, d in enumerate(found, start=1):
                box = [int(d[n]) for n in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
                reason = EDGE_REASONS[int(d["edge"])]
                detections.append((position, d["x_mm"], d["y_mm"], box, int(d["area_px"]), reason))
            emitted, rejections = tracker.step(frame, ts, detections)
            for flight, detection in emitted:
                if flight.birth not in numbers:
                    born += 1
                    numbers[flight.birth] = born
                out.append(
                    (
                        key[0], "track", frame, ts, numbers[flight.birth], flight.status, flight.x,
                        flight.y, flight.vx, flight.vy, flight.p_pos, flight.p_cross, flight.p_vel,
                        flight.hits, flight.misses, detection[0] if detection else None, None,
                    )
                )
            for detection, reason in rejections:
                out.append(
                    (
                        key[0], "rejection", frame, ts, None, None, detection[1], detection[2],
                        *(None,) * 7, detection[0], reason,
                    )
                )
        self._save(tracker, numbers, last, born)
        yield pd.DataFrame(out, columns=_NAMES).astype(
            {n: "Int64" if k == "bigint" else "Int32" for n, k in _OUT if k in ("bigint", "int")}
        )

    def close(self) -> None:
        pass


def frame_rows(observations: DataFrame, timeline: DataFrame) -> DataFrame:
    """Batch helper: the stream's input shape, one row per frame with its detections as an array."""
    found = observations.groupBy("run_id", "frame_index").agg(
        F.collect_list(F.struct(*DETECTION_FIELDS)).alias("detections")
    )
    kind = found.schema["detections"].dataType
    return timeline.join(found, ["run_id", "frame_index"], "left").withColumn(
        "detections", F.coalesce("detections", F.array().cast(kind))
    )


def track_stream(
    frames: DataFrame, view: FieldOfView, settings: TrackerSettings | None = None
) -> DataFrame:
    """Stateful tracking of a stream of frame rows (``FRAME_SCHEMA``).

    A frame is one row, so it never straddles micro-batches; late or repeated frames are reported
    with ``row_kind = 'late'`` instead of stopping the query. Needs the RocksDB state store.
    """
    settings = settings or TrackerSettings()
    view.check_margins(settings)
    order = DETECTION_ORDER

    def before(a, b):
        less = more = F.lit(False)
        for name in reversed(order):
            less = (a[name] < b[name]) | ((a[name] == b[name]) & less)
            more = (a[name] > b[name]) | ((a[name] == b[name]) & more)
        return F.when(less, -1).when(more, 1).otherwise(0)

    marked = F.transform(
        F.array_sort("detections", before),
        lambda d: d.withField(
            "edge",
            touched_margins(d["bbox_x"], d["bbox_w"], F.lit(view.image_width_px), settings),
        ),
    )
    return (
        frames.withColumn("detections", marked)
        .groupBy("run_id")
        .transformWithStateInPandas(
            statefulProcessor=FlightTracker(settings, view),
            outputStructType=OUTPUT_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )
