"""Command log source: JSON envelopes to typed, statically validated command items.

Every check that needs no registry state happens here in Catalyst. A frame batch becomes one item per
bean; whether its items share an event id is looked up on the array, before it is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import STATUSES, is_blank
from ..functions.mathx import is_finite
from ..functions.once import evaluate_once
from ..schemas import BEAN_REF_STRUCT, DECISION_DOC, PREDICTION_DOC, TRACK_DOC

COMMAND_SCHEMA = "flightline-registry/v1"
UPDATE, UPDATES, ENRICH, DECIDE, ACKNOWLEDGE = (
    "update_track", "update_tracks", "add_enrichment", "set_sorting_decision",
    "acknowledge_sorting_decision",
)
WRITES = (UPDATE, UPDATES, ENRICH, DECIDE, ACKNOWLEDGE)
READS = ("ping", "get", "list", "list_active", "events_since")
CONFLICT, STALE, NOT_FOUND, INVALID = "conflict", "stale", "not_found", "invalid"

ENRICHMENT_DOC = (
    "STRUCT<source: STRING, kind: STRING, value: VARIANT, timestamp_ns: BIGINT, version: STRING, "
    "result_id: STRING, confidence: DOUBLE>"
)
_UPDATE_DOC = f"STRUCT<track: {TRACK_DOC}, prediction: {PREDICTION_DOC}, event_id: STRING>"
ENVELOPE = (
    "schema STRING, request_id STRING, operation STRING, payload STRUCT<event_id: STRING, "
    f"bean_ref: {BEAN_REF_STRUCT}, track: {TRACK_DOC}, prediction: {PREDICTION_DOC}, "
    f"updates: ARRAY<{_UPDATE_DOC}>, enrichment: {ENRICHMENT_DOC}, decision: {DECISION_DOC}, "
    "decision_id: STRING, timestamp_ns: BIGINT>"
)


def _sized(value: Column, length: int) -> Column:
    return F.coalesce(F.size(value) == length, F.lit(False)) & ~F.exists(
        value, lambda item: item.isNull()
    )


def _all_finite(value: Column) -> Column:
    return F.forall(value, is_finite)


def observation_problem(o: Column) -> Column:
    d = o["detection"]
    return (
        o["frame_index"].isNull()
        | o["timestamp_ns"].isNull()
        | d.isNull()
        | d["area_px"].isNull()
        | d["solidity"].isNull()
        | ~_sized(d["centroid_px"], 2)
        | ~_sized(d["bbox_px"], 4)
        | ~_sized(d["mean_bgr"], 3)
        | ~_sized(o["position_mm"], 2)
    )


def track_problem(track: Column) -> Column:
    """Message when a track document does not decode, else NULL."""
    history = F.coalesce(track["history"], F.array().cast(_history_type()))
    return (
        F.when(track.isNull(), F.lit("track is required"))
        .when(
            track["bean_ref"]["run_id"].isNull() | track["bean_ref"]["sequence"].isNull(),
            F.lit("bean reference is incomplete"),
        )
        .when(
            track["status"].isNull() | ~track["status"].isin(*STATUSES),
            F.lit("unknown track status"),
        )
        .when(
            track["timestamp_ns"].isNull() | track["hits"].isNull() | track["misses"].isNull(),
            F.lit("track counters are incomplete"),
        )
        .when(~_sized(track["state"], 4), F.lit("track state must contain 4 values"))
        .when(
            ~_sized(track["covariance"], 4)
            | F.coalesce(F.exists(track["covariance"], lambda r: ~_sized(r, 4)), F.lit(True)),
            F.lit("track covariance must be 4x4"),
        )
        .when(~_sized(track["last_bbox_px"], 4), F.lit("track box must contain 4 values"))
        .when(F.exists(history, observation_problem), F.lit("track history is malformed"))
    )


def _history_type() -> str:
    start = TRACK_DOC.index("history: ") + len("history: ")
    return TRACK_DOC[start:-1]


def prediction_problem(p: Column) -> Column:
    missing = (
        p["bean_ref"]["run_id"].isNull() | p["bean_ref"]["sequence"].isNull() | p["gates"].isNull()
        | p["selected_gate_indices"].isNull()
    )
    for name in ("line_y_mm", "crossing_timestamp_ns", "seconds_until_crossing", "x_mean_mm",
                 "x_std_mm", "time_std_ms"):
        missing = missing | p[name].isNull()
    return F.when(p.isNotNull() & missing, F.lit("prediction is malformed"))


def enrichment_problem(e: Column) -> Column:
    return F.when(
        e.isNull() | e["source"].isNull() | e["kind"].isNull() | e["timestamp_ns"].isNull(),
        F.lit("enrichment is malformed"),
    )


def decision_problem(d: Column) -> Column:
    return F.when(
        d.isNull() | d["decision_id"].isNull() | d["source"].isNull() | d["timestamp_ns"].isNull()
        | d["actuation_timestamp_ns"].isNull() | d["gate_indices"].isNull(),
        F.lit("sorting decision is malformed"),
    )


def track_violation(track: Column, prediction: Column) -> Column:
    """First rule a decoded track update breaks on its own, else NULL."""
    latest = F.try_element_at(track["history"], F.lit(-1))
    finite = _all_finite(track["state"]) & F.forall(track["covariance"], _all_finite)
    seen = F.coalesce(
        _all_finite(latest["position_mm"]) & _all_finite(latest["detection"]["centroid_px"])
        & _all_finite(latest["detection"]["mean_bgr"]) & is_finite(latest["detection"]["solidity"]),
        F.lit(True),
    )
    numbers = F.array(
        *[prediction[n] for n in ("line_y_mm", "seconds_until_crossing", "x_mean_mm", "x_std_mm",
                                  "time_std_ms")]
    )
    foretold = prediction.isNull() | (
        _all_finite(numbers)
        & F.forall(
            prediction["gates"],
            lambda g: is_finite(g["probability"]) & is_finite(g["left_mm"])
            & is_finite(g["right_mm"]),
        )
    )
    return (
        F.when(
            is_blank(track["bean_ref"]["run_id"]) | (track["bean_ref"]["sequence"] <= 0),
            F.lit("run_id is blank or sequence is not positive"),
        )
        .when(
            prediction.isNotNull()
            & ~(
                prediction["bean_ref"]["run_id"].eqNullSafe(track["bean_ref"]["run_id"])
                & prediction["bean_ref"]["sequence"].eqNullSafe(track["bean_ref"]["sequence"])
            ),
            F.lit("prediction and track name different beans"),
        )
        .when(~(finite & seen & foretold), F.lit("a number is missing, NaN or infinite"))
    )


def enrichment_violation(e: Column) -> Column:
    return (
        F.when(
            is_blank(e["source"]) | is_blank(e["kind"]),
            F.lit("source or kind of the enrichment is blank"),
        )
        .when(e["timestamp_ns"] < 0, F.lit("timestamp of the enrichment is below zero"))
        .when(
            e["confidence"].isNotNull()
            & (F.isnan(e["confidence"]) | (e["confidence"] < 0) | (e["confidence"] > 1)),
            F.lit("confidence lies outside 0..1"),
        )
    )


def decision_violation(d: Column) -> Column:
    return (
        F.when(is_blank(d["source"]), F.lit("source of the decision is blank"))
        .when(d["timestamp_ns"] < 0, F.lit("timestamp of the decision is below zero"))
        .when(
            d["actuation_timestamp_ns"] < d["timestamp_ns"],
            F.lit("actuation lies before the decision"),
        )
        .when(
            F.size(F.array_distinct(d["gate_indices"])) != F.size(d["gate_indices"]),
            F.lit("a gate is named twice"),
        )
    )


def fingerprint(operation: str, *parts: Column) -> Column:
    """Digest of operation and canonical content; equal content gives equal digests."""
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(operation + "\n"), text), 256)


def _or_default(value: Column, default: Column) -> Column:
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def _exploded(log: DataFrame) -> DataFrame:
    """One row per command, or per update of a frame batch; envelope fields as plain columns."""
    c = F.col
    parsed = evaluate_once(log, c=F.from_json("value", ENVELOPE)).select("command_seq", "c")
    op = c("c.operation")
    single = F.struct(
        c("c.payload.track").alias("track"),
        c("c.payload.prediction").alias("prediction"),
        c("c.payload.event_id").alias("event_id"),
    )
    updates = F.when(op.eqNullSafe(F.lit(UPDATES)), c("c.payload.updates")).otherwise(
        F.array(single)
    )
    given = F.transform(updates, lambda u: u["event_id"])
    rows = parsed.select(
        "command_seq",
        c("c").isNull().alias("unreadable"),
        c("c.schema").alias("schema"),
        F.coalesce(c("c.request_id"), F.lit("")).alias("request_id"),
        F.coalesce(op, F.lit("")).alias("operation"),
        op.eqNullSafe(F.lit(UPDATES)).alias("is_batch"),
        F.coalesce(F.size(F.array_distinct(given)) < F.size(given), F.lit(False)).alias(
            "repeats_id"
        ),
        (op.eqNullSafe(F.lit(UPDATES)) & updates.isNull()).alias("no_updates"),
        c("c.payload").isNull().alias("no_payload"),
        c("c.payload.bean_ref").alias("bean_ref"),
        c("c.payload.enrichment").alias("e"),
        c("c.payload.decision").alias("d"),
        c("c.payload.decision_id").alias("ack_decision_id"),
        c("c.payload.timestamp_ns").alias("ack_ts_given"),
        F.posexplode_outer(updates).alias("item_no", "u"),
    )
    default_id = F.when(
        c("is_batch"), F.concat_ws("#", c("request_id"), c("item_no").cast("string"))
    ).otherwise(c("request_id"))
    return rows.select(
        "*",
        c("u.track").alias("t"),
        c("u.prediction").alias("p"),
        _or_default(c("u.event_id"), default_id).alias("event_id"),
    ).drop("u")


def parse_commands(log: DataFrame) -> DataFrame:
    """``command_seq, value`` (JSON text) to typed rows; ``problem`` marks undecodable ones."""
    c = F.col
    op = c("operation")
    is_update = op.isin(UPDATE, UPDATES)
    rows = _exploded(log)
    bad_ref = F.when(
        c("bean_ref").isNull() | c("bean_ref.run_id").isNull() | c("bean_ref.sequence").isNull(),
        F.lit("bean reference is incomplete"),
    )
    content = (
        F.when(
            is_update,
            F.when(c("no_updates"), F.lit("updates must be an array")).otherwise(
                F.coalesce(track_problem(c("t")), prediction_problem(c("p")))
            ),
        )
        .when(op == ENRICH, F.coalesce(bad_ref, enrichment_problem(c("e"))))
        .when(op == DECIDE, F.coalesce(bad_ref, decision_problem(c("d"))))
        .when(
            op == ACKNOWLEDGE,
            F.coalesce(
                bad_ref,
                F.when(
                    c("ack_decision_id").isNull() | c("ack_ts_given").isNull(),
                    F.lit("acknowledgement is malformed"),
                ),
            ),
        )
    )
    empty_batch = c("is_batch") & ~c("no_updates") & c("item_no").isNull()
    problem = (
        F.when(c("unreadable"), F.lit("line holds no JSON object"))
        .when(
            ~c("schema").eqNullSafe(F.lit(COMMAND_SCHEMA)),
            F.lit("schema is missing or another one"),
        )
        .when(c("request_id") == "", F.lit("request_id is empty"))
        .when(~op.isin(*WRITES, *READS), F.concat(F.lit("no such operation: "), op))
        .when(c("no_payload") & op.isin(*WRITES), F.lit("payload holds no object"))
        .when(empty_batch, F.lit(None).cast("string"))
        .otherwise(content)
    )
    violation = (
        F.when(is_update, track_violation(c("t"), c("p")))
        .when(op == ENRICH, enrichment_violation(c("e")))
        .when(op == DECIDE, decision_violation(c("d")))
    )
    return evaluate_once(evaluate_once(rows, problem=problem), _v=violation).withColumn(
        "violation", F.when(c("problem").isNull(), c("_v"))
    ).drop("_v")


def command_errors(parsed: DataFrame) -> DataFrame:
    """Commands that never reach the registry; one bad update spoils its whole frame batch."""
    return (
        parsed.where(F.col("problem").isNotNull())
        .groupBy("command_seq", "request_id", "operation")
        .agg(F.min_by("problem", F.coalesce("item_no", F.lit(0))).alias("error_message"))
        .select(
            "command_seq", "request_id", "operation",
            F.lit(INVALID).alias("error_type"), "error_message",
        )
    )


def command_items(parsed: DataFrame) -> DataFrame:
    """Bean commands for the fold. An undecodable update stays as a failing item of its batch."""
    c = F.col
    op = c("operation")
    is_update = op.isin(UPDATE, UPDATES)
    result_id = _or_default(c("e.result_id"), c("event_id"))
    decision_id = _or_default(c("d.decision_id"), c("event_id"))
    enrichment = F.struct(
        c("e.source").alias("source"),
        c("e.kind").alias("kind"),
        F.to_json("e.value").alias("value_json"),
        c("e.timestamp_ns").alias("timestamp_ns"),
        F.coalesce(c("e.version"), F.lit("")).alias("version"),
        result_id.alias("result_id"),
        c("e.confidence").alias("confidence"),
    )
    decision = F.struct(
        decision_id.alias("decision_id"),
        c("d.source").alias("source"),
        c("d.timestamp_ns").alias("timestamp_ns"),
        c("d.actuation_timestamp_ns").alias("actuation_timestamp_ns"),
        c("d.gate_indices").alias("gate_indices"),
        F.coalesce(c("d.policy_version"), F.lit("")).alias("policy_version"),
        F.coalesce(c("d.reason"), F.lit("")).alias("reason"),
        c("d.acknowledged_timestamp_ns").alias("acknowledged_timestamp_ns"),
    )
    usable = parsed.where(
        op.isin(*WRITES)
        & c("item_no").isNotNull()
        & (c("problem").isNull() | (c("is_batch") & (c("request_id") != "")))
        & c("schema").eqNullSafe(F.lit(COMMAND_SCHEMA))
    )
    staged = usable.select(
        "command_seq", "item_no", "request_id", "is_batch", "repeats_id", "event_id",
        F.when(is_update, F.lit(UPDATE)).otherwise(op).alias("op"),
        "problem",
        F.coalesce("problem", "violation").alias("static_error"),
        F.coalesce(F.when(is_update, c("t.bean_ref.run_id")), c("bean_ref.run_id"), F.lit("")).alias("run_id"),
        F.coalesce(F.when(is_update, c("t.bean_ref.sequence")), c("bean_ref.sequence"), F.lit(0)).alias("sequence"),
        c("t").alias("track"),
        c("p").alias("prediction"),
        F.when(op == ENRICH, enrichment).alias("enrichment"),
        F.when(op == DECIDE, decision).alias("decision"),
        "ack_decision_id",
        "ack_ts_given",
    )
    t, d = c("track"), c("decision")
    track_print = fingerprint(
        UPDATE, t["bean_ref"], t["status"], t["timestamp_ns"], t["state"], t["covariance"],
        t["hits"], t["misses"], t["last_bbox_px"], F.slice(t["history"], -1, 1), c("prediction"),
    )
    by_op = lambda update, enrich, decide, ack: (
        F.when(c("op") == UPDATE, update)
        .when(c("op") == ENRICH, enrich)
        .when(c("op") == DECIDE, decide)
        .otherwise(ack)
    )
    none = F.lit(None)
    return evaluate_once(
        staged,
        **{
            "fingerprint": by_op(
                track_print,
                fingerprint(ENRICH, c("enrichment")),
                fingerprint(DECIDE, d),
                fingerprint(ACKNOWLEDGE, c("ack_decision_id"), c("ack_ts_given")),
            ),
            "status": t["status"],
            "ts": by_op(
                t["timestamp_ns"], c("enrichment.timestamp_ns"), d["timestamp_ns"],
                c("ack_ts_given"),
            ),
            "first_ts": F.coalesce(
                F.try_element_at(t["history"], F.lit(1))["timestamp_ns"], t["timestamp_ns"]
            ),
            "part_id": by_op(
                none.cast("string"), c("enrichment.result_id"), d["decision_id"],
                c("ack_decision_id"),
            ),
            "part_hash": by_op(
                none.cast("string"),
                fingerprint("", c("enrichment")),
                fingerprint(
                    "", d["decision_id"], d["source"], d["timestamp_ns"],
                    d["actuation_timestamp_ns"], d["gate_indices"], d["policy_version"],
                    d["reason"],
                ),
                none.cast("string"),
            ),
            "ack_ts": d["acknowledged_timestamp_ns"],
        },
    ).drop("ack_decision_id", "ack_ts_given")
