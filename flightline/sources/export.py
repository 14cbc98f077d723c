"""Run documents and record documents: nested JSON out, validated records back in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import STATUSES, bean_label
from ..functions.once import evaluate_once
from ..operators.prediction import arrival, gate_indices, gate_labels, seconds_ahead, with_chances
from ..registry.commands import (
    decision_problem,
    enrichment_problem,
    prediction_problem,
    track_problem,
)
from ..schemas import BEAN_REF_STRUCT, DECISION_DOC, PREDICTION_DOC, TRACK_DOC
from ..settings import GateLayout, TrackerSettings

RUN_SCHEMA = "flightline-analysis/v1"
RECORD = (
    f"bean_ref {BEAN_REF_STRUCT}, revision BIGINT, status STRING, created_timestamp_ns BIGINT, "
    f"updated_timestamp_ns BIGINT, track {TRACK_DOC}, prediction {PREDICTION_DOC}, "
    "enrichments ARRAY<STRUCT<source: STRING, kind: STRING, value: STRING, timestamp_ns: BIGINT, "
    "version: STRING, result_id: STRING, confidence: DOUBLE>>, "
    f"decision {DECISION_DOC}"
)
_FRAME = ["run_id", "frame_index"]


def frame_documents(
    timeline: DataFrame, snapshots: DataFrame, rejections: DataFrame, layout: GateLayout,
    settings: TrackerSettings | None = None,
) -> DataFrame:
    """One nested struct per processed frame; its arrays hold what one image can hold.

    What moves is a narrow row per snapshot or rejection; crossings and gates of a frame are worked out where
    the frame is put together.
    """
    s = settings or TrackerSettings()
    state = ("x_mm", "y_mm", "vx_mm_s", "vy_mm_s")
    track = F.struct("sequence", "status", *state, "p_pos", "p_cross", "p_vel", "hits", "misses")
    rejected = F.struct(
        "row_ord", "reason", F.array("cx_px", "cy_px").alias("centroid_px"),
        F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox_px"),
    )
    both = snapshots.select(*_FRAME, track.alias("_t")).unionByName(
        rejections.select(*_FRAME, rejected.alias("_r")), allowMissingColumns=True
    )
    packed = both.groupBy(*_FRAME).agg(
        F.array_sort(F.collect_list("_t")).alias("_tracks"), F.array_sort(F.collect_list("_r")).alias("_rejections")
    )
    whole = timeline.join(packed, _FRAME, "left").withColumns(
        {name: F.coalesce(name, F.array().cast(packed.schema[name].dataType)) for name in ("_tracks", "_rejections")}
    )
    bean = lambda t: bean_label(F.col("run_id"), t["sequence"]).alias("bean_id")
    labels = F.array(*[F.lit(text) for text in gate_labels(layout)])
    indices = F.array(*[F.lit(i) for i in gate_indices(layout)])
    chosen = lambda chances: F.filter(
        F.zip_with(indices, chances, lambda i, p: F.when(p >= layout.actuation_probability_threshold, i)),
        lambda i: i.isNotNull(),
    )
    line = F.lit(float(layout.line_y_mm))
    timed = F.transform("_tracks", lambda t: t.withField("seconds_until_crossing", seconds_ahead(t.getField, line, s)))
    crossed = F.transform(timed, lambda t: F.struct(
        *[t[f].alias(f) for f in ("sequence", "status", *state, "hits", "misses", "seconds_until_crossing")],
        *[value.alias(name) for name, value in arrival(t.getField, F.col("timestamp_ns"), s).items()],
    ))
    foretold = F.zip_with("_tracks", "_chances", lambda t, c: F.when(
        t["seconds_until_crossing"].isNotNull(),
        F.struct(
            bean(t), line.alias("line_y_mm"), t["crossing_timestamp_ns"].alias("crossing_timestamp_ns"),
            t["x_mean_mm"].alias("x_mean_mm"), t["x_std_mm"].alias("x_std_mm"), t["time_std_ms"].alias("time_std_ms"),
            chosen(c).alias("selected_gate_indices"), F.map_from_arrays(labels, c).alias("gate_probabilities"),
        ),
    ))
    tracks = F.transform("_tracks", lambda t: F.struct(
        bean(t), t["status"].alias("status"), F.array(*[t[f] for f in state]).alias("state"), t["hits"].alias("hits"), t["misses"].alias("misses")
    ))
    return with_chances(whole.withColumn("_tracks", crossed), layout, "_tracks", "_chances").select(
        *timeline.columns,
        F.transform("_rejections", lambda r: F.struct(
            r["reason"].alias("reason"), r["centroid_px"].alias("centroid_px"), r["bbox_px"].alias("bbox_px")
        )).alias("rejections"),
        tracks.alias("tracks"), F.filter(foretold, lambda p: p.isNotNull()).alias("predictions"),
    )


def frame_json(frames: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``run_id, frame_index, document``: one JSON line per frame."""
    fields = ["frame_index", "timestamp_ns", *(extra or []), "rejections", "tracks", "predictions"]
    return frames.select(
        *_FRAME, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document")
    )


def run_headers(runs: DataFrame, latency: DataFrame) -> DataFrame:
    """Document header per run: provenance and performance."""
    body = F.struct(
        F.lit(RUN_SCHEMA).alias("schema"), "run_id", "source_path", "exact_timestamps",
        F.struct(
            F.col("method"), F.col("frame_indices"), F.col("candidate_seed")
        ).alias("background"),
        F.struct(
            F.coalesce("mean_ms", F.lit(0.0)).alias("mean_processing_ms"),
            F.coalesce("p95_ms", F.lit(0.0)).alias("p95_processing_ms"),
        ).alias("performance"),
    )
    joined = runs.join(latency, "run_id", "left")
    return joined.select(
        "run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("header")
    )


def export_runs(headers: DataFrame, frames: DataFrame, path: str) -> None:
    """Write each run as a folder ``run_id=...`` holding a header line and sorted frame lines.

    A run stays many tasks and no task builds a whole document. Runs that are written again replace
    their own folder; other runs under ``path`` stay.
    """
    lines = headers.select(
        "run_id", F.lit(-1).cast("long").alias("frame_index"), F.col("header").alias("value")
    ).unionByName(frames.select(*_FRAME, F.col("document").alias("value")))
    (
        lines.repartitionByRange("run_id", "frame_index")
        .sortWithinPartitions("run_id", "frame_index")
        .select("run_id", "value")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").text(path)
    )


def run_documents(headers: DataFrame, frames: DataFrame) -> DataFrame:
    """One JSON text per run, for recordings known to be short (a single camera pass)."""
    packed = frames.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_index", "document"))).alias("_f")
    )
    texts = F.transform("_f", lambda f: f["document"])
    body = F.concat(F.lit(',"frames":['), F.array_join(texts, ","), F.lit("]}"))
    head = F.expr("substring(header, 1, length(header) - 1)")
    return headers.join(packed, "run_id").select("run_id", F.concat(head, body).alias("document"))


def decode_records(lines: DataFrame) -> DataFrame:
    """``value`` (JSON text) to typed records with ``problem`` for those that must be quarantined."""
    parsed = evaluate_once(lines, r=F.from_json("value", RECORD))
    r = F.col("r")
    same = lambda ref: (
        ref["run_id"].eqNullSafe(r["bean_ref"]["run_id"])
        & ref["sequence"].eqNullSafe(r["bean_ref"]["sequence"])
    )
    enrichments = F.exists(
        F.coalesce(r["enrichments"], F.array().cast(parsed.schema["r"].dataType["enrichments"].dataType)),
        lambda e: enrichment_problem(e).isNotNull(),
    )
    problem = F.coalesce(
        F.when(r.isNull() | r["bean_ref"].isNull(), F.lit("record is not an object")),
        F.when(
            r["revision"].isNull() | r["created_timestamp_ns"].isNull()
            | r["updated_timestamp_ns"].isNull(),
            F.lit("record counters are incomplete"),
        ),
        F.when(~F.coalesce(r["status"].isin(*STATUSES), F.lit(False)), F.lit("unknown record status")),
        track_problem(r["track"]),
        F.when(~same(r["track"]["bean_ref"]), F.lit("track names another bean than its record")),
        prediction_problem(r["prediction"]),
        F.when(
            r["prediction"].isNotNull() & ~same(r["prediction"]["bean_ref"]),
            F.lit("prediction names another bean than its record"),
        ),
        F.when(enrichments, F.lit("enrichment is malformed")),
        F.when(r["decision"].isNotNull(), decision_problem(r["decision"])),
    )
    return evaluate_once(parsed, problem=problem).select("value", "r.*", "problem")
