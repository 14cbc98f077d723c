"""Questions asked of the registry: current records, journal pages, recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ACTIVE, STATUSES, TERMINAL
from .tables import BEAN


class BeanNotFound(LookupError):
    """No such bean."""


class HistoryGap(LookupError):
    """The cursor is older than the retained journal."""


def records(tables: dict[str, DataFrame], *, include_history: bool = True) -> DataFrame:
    """Current record of every bean in one plan: latest track, prediction of exactly that revision,
    enrichments in arrival order, latest decision and, if wanted, the whole history."""
    latest = tables["track_states"].groupBy(*BEAN).agg(
        F.max_by(
            F.struct(
                "registry_revision", "status", "timestamp_ns", "x_mm", "y_mm", "vx_mm_s",
                "vy_mm_s", "covariance", "hits", "misses", "last_bbox_px",
            ),
            "registry_revision",
        ).alias("track")
    )
    predicted = tables["predictions"].select(*BEAN, "registry_revision", "prediction")
    enriched = tables["enrichments"].groupBy(*BEAN).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "registry_revision", "result_id", "source", "kind", "value_json",
                    "timestamp_ns", "model_version", "confidence",
                )
            )
        ).alias("enrichments")
    )
    decided = tables["sorting_decisions"].groupBy(*BEAN).agg(
        F.max_by(
            F.struct(
                "decision_id", "source", "timestamp_ns", "actuation_timestamp_ns", "gate_indices",
                "policy_version", "reason", "acknowledged_timestamp_ns",
            ),
            F.struct("registry_revision", "decision_id"),
        ).alias("decision")
    )
    result = (
        tables["beans"].join(latest, BEAN, "left")
        .withColumn("registry_revision", F.col("track.registry_revision"))
        .join(predicted, [*BEAN, "registry_revision"], "left")
        .drop("registry_revision")
        .join(enriched, BEAN, "left")
        .join(decided, BEAN, "left")
    )
    if include_history:
        history = tables["observations"].groupBy(*BEAN).agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "frame_index", "timestamp_ns", "x_mm", "y_mm", "centroid_px", "bbox_px",
                        "area_px", "solidity", "mean_bgr",
                    )
                )
            ).alias("history")
        )
        result = result.join(history, BEAN, "left")
    return result


def get_record(current: DataFrame, run_id: str, sequence: int) -> DataFrame:
    found = current.where((F.col("run_id") == run_id) & (F.col("sequence") == sequence))
    if found.isEmpty():
        raise BeanNotFound(f"unknown bean {run_id[:8]}/{sequence:06d}")
    return found


def list_records(
    current: DataFrame, *, run_id: str | None = None, statuses: Sequence[str] | None = None
) -> DataFrame:
    chosen = current
    if run_id is not None:
        chosen = chosen.where(F.col("run_id") == run_id)
    if statuses is not None:
        unknown = set(statuses) - set(STATUSES)
        if unknown:
            raise ValueError(f"unknown statuses: {sorted(unknown)}")
        chosen = chosen.where(F.col("status").isin(*statuses) if statuses else F.lit(False))
    return chosen.orderBy(*BEAN)


def list_active(current: DataFrame, *, run_id: str | None = None) -> DataFrame:
    return list_records(current, run_id=run_id, statuses=ACTIVE)


def events_since(events: DataFrame, after_sequence: int, *, limit: int = 1_000) -> DataFrame:
    """One page of the journal after a cursor, in order."""
    if after_sequence < 0:
        raise ValueError("after_sequence is below zero")
    if not 1 <= limit <= 10_000:
        raise ValueError("limit lies outside 1..10000")
    later = events.where(F.col("stream_sequence") > after_sequence)
    return later.orderBy("stream_sequence").limit(limit)


def event_records(page: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``page`` (rows of ``registry_events``) with the bean's record as each event left it.

    The record of an event is an as-of join of every normalised table at the event's revision, made
    for the beans of the page only: the journal itself holds narrow rows, however long a bean lives
    and however many enrichments it gathers. ``tables`` also holds ``decision_events``. A page should
    be bounded, as ``events_since`` makes it. ``record`` has no history of observations.
    """
    wanted = page.select(*BEAN).distinct()

    def of(name: str) -> DataFrame:
        return tables[name].join(wanted, BEAN, "left_semi")

    state = F.struct(
        "registry_revision", "status", "timestamp_ns", "x_mm", "y_mm", "vx_mm_s", "vy_mm_s",
        "covariance", "hits", "misses", "last_bbox_px",
    )
    moments = (
        of("registry_events").select(*BEAN, "revision", "stream_sequence", "timestamp_ns")
        .unionByName(
            of("track_states").select(*BEAN, F.col("registry_revision").alias("revision"), state.alias("track")),
            allowMissingColumns=True,
        )
        .unionByName(
            of("decision_events").select(
                *BEAN, "revision", F.struct("revision", "kind", "timestamp_ns", "decision").alias("step")
            ),
            allowMissingColumns=True,
        )
    )
    # A range frame: rows of the same revision count, whatever table they come from.
    upto = Window.partitionBy(*BEAN).orderBy("revision").rangeBetween(Window.unboundedPreceding, 0)

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(upto)

    decided = F.when(F.col("step.kind") == "sorting.decision", F.col("step"))
    acked = F.when(F.col("step.kind") == "sorting.acknowledged", F.col("step"))
    as_of = moments.select(
        *BEAN, "revision", "stream_sequence",
        latest(F.col("track")).alias("track"), latest(decided).alias("d"), latest(acked).alias("a"),
        F.max("timestamp_ns").over(upto).alias("updated_timestamp_ns"),
    ).join(page.select("stream_sequence"), "stream_sequence", "left_semi")
    made = of("beans").select(*BEAN, "created_timestamp_ns")
    predicted = of("predictions").select(
        *BEAN, F.col("registry_revision").alias("track_revision"), "prediction"
    )
    arrived = of("enrichments").select(
        *BEAN,
        F.struct(
            "registry_revision", "result_id", "source", "kind", "value_json", "timestamp_ns",
            "model_version", "confidence",
        ).alias("e"),
    )
    gathered = (
        as_of.select(*BEAN, "revision", "stream_sequence").join(arrived, BEAN)
        .where(F.col("e.registry_revision") <= F.col("revision"))
        .groupBy("stream_sequence").agg(F.sort_array(F.collect_list("e")).alias("enrichments"))
    )
    since = F.col("a.revision") > F.col("d.revision")
    ack = F.when(since, F.col("a.timestamp_ns")).otherwise(F.col("d.decision.acknowledged_timestamp_ns"))
    decision = F.when(
        F.col("d").isNotNull(), F.col("d.decision").withField("acknowledged_timestamp_ns", ack)
    )
    whole = (
        as_of.withColumn("track_revision", F.col("track.registry_revision"))
        .join(predicted, [*BEAN, "track_revision"], "left")
        .join(gathered, "stream_sequence", "left")
        .join(made, BEAN)
    )
    record = F.struct(
        F.struct(*BEAN).alias("bean_ref"), "revision", F.col("track.status").alias("status"),
        "created_timestamp_ns", "updated_timestamp_ns", F.col("track").dropFields("registry_revision").alias("track"),
        "prediction", "enrichments", decision.alias("decision"),
    )
    return page.join(whole.select("stream_sequence", record.alias("record")), "stream_sequence")


def check_cursor(retained: DataFrame, after_sequence: int) -> None:
    """Raise when events between the cursor and the retained journal are gone."""
    oldest = retained.agg(F.min("stream_sequence")).first()[0]
    if oldest is not None and after_sequence < oldest - 1:
        raise HistoryGap("events after this cursor are no longer kept")


def journal_gaps(events: DataFrame, block_width: int = 65_536) -> DataFrame:
    """Missing stretches of ``stream_sequence``: found per block plus one row per block border."""
    block = F.floor(F.col("stream_sequence") / block_width).alias("_block")
    blocked = events.select("stream_sequence", block).distinct()
    inside = blocked.withColumn(
        "_prev", F.lag("stream_sequence").over(Window.partitionBy("_block").orderBy("stream_sequence"))
    ).where(F.col("_prev").isNotNull()).select("_prev", "stream_sequence")
    edges = blocked.groupBy("_block").agg(
        F.min("stream_sequence").alias("lo"), F.max("stream_sequence").alias("hi")
    )
    borders = edges.withColumn("_prev", F.lag("hi").over(Window.orderBy("_block"))).select(
        F.coalesce("_prev", F.lit(0)).alias("_prev"), F.col("lo").alias("stream_sequence")
    )
    return inside.unionByName(borders).where(
        F.col("stream_sequence") > F.col("_prev") + 1
    ).select(
        (F.col("_prev") + 1).alias("first_missing"),
        (F.col("stream_sequence") - 1).alias("last_missing"),
    )


def event_history(events: DataFrame, run_id: str, sequence: int) -> DataFrame:
    return events.where(
        (F.col("run_id") == run_id) & (F.col("sequence") == sequence)
    ).orderBy("stream_sequence")


def event_identity(events: DataFrame, event_id: str) -> DataFrame:
    """Owner and command fingerprint of an event id."""
    return events.where((F.col("event_id") == event_id) & (F.lit(event_id) != "")).select(
        "run_id", "sequence", "command_fingerprint"
    )


def by_topic(events: DataFrame, prefix: str = "") -> DataFrame:
    """Events whose kind starts with a prefix; works on streams too."""
    return events.where(F.col("kind").startswith(prefix))


def enrichments_by_kind(enrichments: DataFrame) -> DataFrame:
    """Per bean: kind -> values in arrival order."""
    per_kind = enrichments.groupBy(*BEAN, "kind").agg(
        F.sort_array(
            F.collect_list(F.struct("registry_revision", "result_id", "value_json"))
        ).alias("items")
    )
    values = F.transform("items", lambda item: item["value_json"])
    return per_kind.groupBy(*BEAN).agg(
        F.map_from_entries(F.collect_list(F.struct("kind", values))).alias("by_kind")
    )


def evict_completed(current: DataFrame, before_timestamp_ns: int) -> tuple[DataFrame, DataFrame]:
    """Split hot records into (kept, evicted); history tables are untouched."""
    done = (
        F.col("status").isin(*TERMINAL)
        & (F.col("updated_timestamp_ns") < before_timestamp_ns)
        & (
            F.col("decision").isNull()
            | F.col("decision.acknowledged_timestamp_ns").isNotNull()
        )
    )
    return current.where(~done), current.where(done)


def record_documents(current: DataFrame) -> DataFrame:
    """JSON text per record."""
    body = F.struct(*[F.col(name) for name in current.columns])
    return current.select(*BEAN, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
