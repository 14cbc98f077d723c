"""Column contracts shared by operators."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("x_mm", T.DoubleType()),
        T.StructField("y_mm", T.DoubleType()),
        T.StructField("cx_px", T.DoubleType()),
        T.StructField("cy_px", T.DoubleType()),
        T.StructField("bbox_x", T.IntegerType()),
        T.StructField("bbox_y", T.IntegerType()),
        T.StructField("bbox_w", T.IntegerType()),
        T.StructField("bbox_h", T.IntegerType()),
        T.StructField("area_px", T.LongType()),
    ]
)
OBSERVATION_COLUMNS = OBSERVATION.fieldNames()

TIMELINE = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
    ]
)

BEAN_REF_STRUCT = "STRUCT<run_id: STRING, sequence: BIGINT>"
_DETECTION = (
    "STRUCT<centroid_px: ARRAY<DOUBLE>, bbox_px: ARRAY<BIGINT>, area_px: BIGINT, "
    "solidity: DOUBLE, mean_bgr: ARRAY<DOUBLE>>"
)
OBSERVATION_DOC = (
    f"STRUCT<frame_index: BIGINT, timestamp_ns: BIGINT, detection: {_DETECTION}, "
    "position_mm: ARRAY<DOUBLE>>"
)
TRACK_DOC = (
    f"STRUCT<bean_ref: {BEAN_REF_STRUCT}, status: STRING, timestamp_ns: BIGINT, "
    "state: ARRAY<DOUBLE>, covariance: ARRAY<ARRAY<DOUBLE>>, hits: BIGINT, misses: BIGINT, "
    f"last_bbox_px: ARRAY<BIGINT>, history: ARRAY<{OBSERVATION_DOC}>>"
)
GATE_DOC = "STRUCT<index: INT, left_mm: DOUBLE, right_mm: DOUBLE, probability: DOUBLE>"
PREDICTION_DOC = (
    f"STRUCT<bean_ref: {BEAN_REF_STRUCT}, line_y_mm: DOUBLE, crossing_timestamp_ns: BIGINT, "
    "seconds_until_crossing: DOUBLE, x_mean_mm: DOUBLE, x_std_mm: DOUBLE, time_std_ms: DOUBLE, "
    f"gates: ARRAY<{GATE_DOC}>, selected_gate_indices: ARRAY<INT>>"
)
DECISION_DOC = (
    "STRUCT<decision_id: STRING, source: STRING, timestamp_ns: BIGINT, "
    "actuation_timestamp_ns: BIGINT, gate_indices: ARRAY<INT>, policy_version: STRING, "
    "reason: STRING, acknowledged_timestamp_ns: BIGINT>"
)
