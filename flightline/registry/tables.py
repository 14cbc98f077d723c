"""The eight normalised tables behind the registry, derived from journal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEAN = ["run_id", "sequence"]
EVENT_FIELDS = (
    "stream_sequence bigint, event_id string, kind string, run_id string, sequence bigint, "
    "revision bigint, timestamp_ns bigint, command_fingerprint string"
)
TRACK_KINDS = ("bean.created", "bean.confirmed", "bean.exited", "bean.cancelled", "track.updated")


def sessions(journal: DataFrame) -> DataFrame:
    return journal.groupBy("run_id").agg(F.min("created_ts").alias("created_timestamp_ns"))


def beans(journal: DataFrame) -> DataFrame:
    """Current revision, status and times of every bean; the creation time never changes."""
    return journal.groupBy(*BEAN).agg(
        F.max("revision").alias("revision"),
        F.max_by("bean_status", "revision").alias("status"),
        F.min_by("created_ts", "revision").alias("created_timestamp_ns"),
        F.max_by("updated_ts", "revision").alias("updated_timestamp_ns"),
    )


def track_states(journal: DataFrame) -> DataFrame:
    t = F.col("track")
    return journal.where(F.col("kind").isin(*TRACK_KINDS)).select(
        *BEAN, F.col("revision").alias("registry_revision"), t["status"].alias("status"),
        t["timestamp_ns"].alias("timestamp_ns"), t["state"][0].alias("x_mm"),
        t["state"][1].alias("y_mm"), t["state"][2].alias("vx_mm_s"), t["state"][3].alias("vy_mm_s"),
        t["covariance"].alias("covariance"), t["hits"].alias("hits"), t["misses"].alias("misses"),
        t["last_bbox_px"].alias("last_bbox_px"),
    )


def observations(journal: DataFrame) -> DataFrame:
    """Insert-or-ignore on (run, sequence, frame): the creating update brings its whole history,
    later ones their newest observation."""
    history = F.col("track.history")
    added = F.when(F.col("kind") == "bean.created", history).otherwise(F.slice(history, -1, 1))
    rows = journal.where(F.col("kind").isin(*TRACK_KINDS)).select(
        *BEAN, "revision", F.posexplode(added).alias("_pos", "o")
    )
    first = F.min_by("o", F.struct("revision", "_pos"))
    d = F.col("o.detection")
    return (
        rows.withColumn("frame_index", F.col("o.frame_index"))
        .groupBy(*BEAN, "frame_index")
        .agg(first.alias("o"))
        .select(
            *BEAN, "frame_index", F.col("o.timestamp_ns").alias("timestamp_ns"),
            F.col("o.position_mm")[0].alias("x_mm"), F.col("o.position_mm")[1].alias("y_mm"),
            d["centroid_px"].alias("centroid_px"), d["bbox_px"].alias("bbox_px"),
            d["area_px"].alias("area_px"), d["solidity"].alias("solidity"),
            d["mean_bgr"].alias("mean_bgr"),
        )
    )


def predictions(journal: DataFrame) -> DataFrame:
    return journal.where(
        F.col("kind").isin(*TRACK_KINDS) & F.col("prediction").isNotNull()
    ).select(
        *BEAN, F.col("revision").alias("registry_revision"),
        F.col("track.timestamp_ns").alias("timestamp_ns"), "prediction",
    )


def enrichments(journal: DataFrame) -> DataFrame:
    """Every accepted enrichment: a bean takes a result_id once, and other beans may use it too."""
    e = F.col("enrichment")
    return journal.where(F.col("kind") == "enrichment.added").select(
        *BEAN, e["result_id"].alias("result_id"),
        F.col("revision").alias("registry_revision"), e["source"].alias("source"),
        e["kind"].alias("kind"), e["value_json"].alias("value_json"),
        e["timestamp_ns"].alias("timestamp_ns"), e["version"].alias("model_version"),
        e["confidence"].alias("confidence"),
    )


def first_enrichments(journal: DataFrame) -> DataFrame:
    """The first accepted enrichment of every result id, whichever bean it came to."""
    added = journal.where(F.col("kind") == "enrichment.added").select("stream_sequence", *BEAN, "revision", "kind", "enrichment")
    first = added.groupBy(F.col("enrichment.result_id").alias("_id")).agg(
        F.min(F.struct("stream_sequence", *BEAN, "revision", "kind", "enrichment")).alias("_first")
    )
    return enrichments(first.select("_first.*"))


def sorting_decisions(journal: DataFrame) -> DataFrame:
    """One row per bean and decision_id: first content, then only revision and acknowledgement move.

    A bean's later events keep touching its current decision, so the revision stored is that of
    the last event before another decision replaced it.
    """
    order = Window.partitionBy(*BEAN).orderBy("revision")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.col("decision"), ignorenulls=True).over(upto)
    ack = F.when(F.col("kind") == "sorting.acknowledged", F.col("ts")).otherwise(
        F.col("decision.acknowledged_timestamp_ns")
    )
    rows = (
        journal.withColumn("_d", current)
        .where(F.col("_d").isNotNull())
        .withColumn("_set", F.sum((F.col("kind") == "sorting.decision").cast("int")).over(upto))
        .withColumn(
            "_ack",
            F.last(ack, ignorenulls=True).over(
                Window.partitionBy(*BEAN, "_set").orderBy("revision")
                .rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )
    kept = rows.groupBy(*BEAN, F.col("_d.decision_id").alias("decision_id")).agg(
        F.min_by("_d", "revision").alias("d"),
        F.max(F.struct("revision", "_ack")).alias("last"),
    )
    d = F.col("d")
    return kept.select(
        "decision_id", *BEAN,
        F.col("last.revision").alias("registry_revision"), d["source"].alias("source"),
        d["timestamp_ns"].alias("timestamp_ns"),
        d["actuation_timestamp_ns"].alias("actuation_timestamp_ns"),
        d["gate_indices"].alias("gate_indices"), d["policy_version"].alias("policy_version"),
        d["reason"].alias("reason"), F.col("last._ack").alias("acknowledged_timestamp_ns"),
    )


def decision_events(journal: DataFrame) -> DataFrame:
    """Every decision and acknowledgement at its revision, from which earlier states follow."""
    return journal.where(F.col("kind").isin("sorting.decision", "sorting.acknowledged")).select(
        *BEAN, "revision", "kind", F.col("ts").alias("timestamp_ns"), "decision"
    )


def registry_events(journal: DataFrame) -> DataFrame:
    return journal.select(
        "stream_sequence", "event_id", "kind", *BEAN, "revision",
        F.col("ts").alias("timestamp_ns"), F.col("fingerprint").alias("command_fingerprint"),
    )


TABLES = {
    "sessions": sessions,
    "beans": beans,
    "track_states": track_states,
    "observations": observations,
    "predictions": predictions,
    "enrichments": enrichments,
    "sorting_decisions": sorting_decisions,
    "registry_events": registry_events,
}


def normalise(journal: DataFrame) -> dict[str, DataFrame]:
    return {name: build(journal) for name, build in TABLES.items()}


def audit_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts
