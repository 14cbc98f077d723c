"""String renderings and lifecycle vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifecycle states and the transitions a registry accepts.
TENTATIVE, CONFIRMED, OCCLUDED, EXITED, CANCELLED = (
    "tentative", "confirmed", "occluded", "exited", "cancelled",
)
STATUSES = (TENTATIVE, CONFIRMED, OCCLUDED, EXITED, CANCELLED)
ACTIVE = (TENTATIVE, CONFIRMED, OCCLUDED)
TERMINAL = (EXITED, CANCELLED)
TRANSITIONS = {
    TENTATIVE: (TENTATIVE, CONFIRMED, CANCELLED),
    CONFIRMED: (CONFIRMED, OCCLUDED, EXITED),
    OCCLUDED: (OCCLUDED, CONFIRMED, EXITED),
    EXITED: (),
    CANCELLED: (),
}


def bean_label(run_id: Column, sequence: Column) -> Column:
    """First eight characters of the run and the zero-padded sequence."""
    return F.format_string("%s/%06d", F.substring(run_id, 1, 8), sequence)


def gate_label(index: Column) -> Column:
    """``G+3``, ``G-2``; the centre gate is ``G0``."""
    return F.when(index == 0, F.lit("G0")).when(index.isNotNull(), F.format_string("G%+d", index))


def is_blank(value: Column) -> Column:
    """Null, empty or nothing but white space of any kind."""
    return value.isNull() | value.rlike(r"(?U)^\s*$")


def track_event_id(run_id: Column, sequence: Column, frame: Column, status: Column) -> Column:
    """Idempotency key of one published track update."""
    return F.concat_ws(
        ":", F.lit("track"), run_id, sequence.cast("string"), frame.cast("string"), status
    )


def transition_allowed(previous: Column, incoming: Column) -> Column:
    """True when ``incoming`` may follow ``previous``; NULL previous allows anything."""
    rule = F.lit(False)
    for state, targets in TRANSITIONS.items():
        if targets:
            rule = rule | ((previous == state) & incoming.isin(*targets))
    return previous.isNull() | rule
