"""Command fold: which commands apply, in what order, with what revision.

State belongs to one bean, so items are hash-partitioned by bean, sorted by command and streamed
through a small state machine. Two rules reach across beans: a frame batch is all-or-nothing, and an
event id belongs to the first accepted command that used it. Both are settled by iterating to a fixed
point: assume no failure, fold, find failed batches and foreign id claims, refold only the touched
beans. Whatever a command sees depends only on earlier commands, so the fixed point is unique and
equals the sequential result, while a busy run never has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CANCELLED, CONFIRMED, EXITED, TENTATIVE, TRANSITIONS
from ..functions.prefix import number_rows
from ..functions.spread import spread
from ..plans.durable import durable
from .commands import ACKNOWLEDGE, CONFLICT, DECIDE, ENRICH, INVALID, NOT_FOUND, STALE, UPDATE

APPLIED, DUPLICATE, NOOP, REJECTED, ROLLED_BACK = (
    "applied", "duplicate", "noop", "rejected", "rolled_back",
)
BEAN = ["run_id", "sequence"]
_SLIM = (
    "run_id", "sequence", "command_seq", "item_no", "is_batch", "batch_failed", "batch_clash",
    "foreign_claim", "op", "event_id", "fingerprint", "problem", "static_error", "status", "ts", "first_ts",
    "part_id", "part_hash", "ack_ts", "stored_id", "stored_part_hash", "seed",
)
#: What an earlier fold left of a bean; such a row opens the bean's items and has no outcome.
SEED = "seed"
SEED_STATE = (
    "STRUCT<revision: BIGINT, status: STRING, track_ts: BIGINT, created: BIGINT, updated: BIGINT, "
    "decision_id: STRING, decision_hash: STRING, decision_ts: BIGINT, decision_ack: BIGINT>"
)
#: Whether an event id that an earlier fold accepted was used for the same command.
SAME, OTHER = "same", "other"
_STORED = {"stored_id": "string", "stored_part_hash": "string", "seed": SEED_STATE}
OUTCOME_FIELDS = (
    "outcome string, error_type string, error_message string, revision bigint, kind string, "
    "bean_status string, created_ts bigint, updated_ts bigint"
)
_OUTCOME_ARROW = [
    (field.split()[0], {"string": pa.string(), "bigint": pa.int64()}[field.split()[1]])
    for field in OUTCOME_FIELDS.split(", ")
]
_OUTCOME_NAMES = [name for name, _ in _OUTCOME_ARROW]
_ITEM_COLUMNS = [
    name for name in _SLIM if name not in ("batch_failed", "batch_clash", "foreign_claim")
] + ["repeats_id"]
#: What ``settle`` reads of items.
SETTLED_FROM = [name for name in _ITEM_COLUMNS if name not in _STORED]
#: What verdicts are passed on: narrow rows of the items that reach across beans.
_LINKED = ("command_seq", "item_no", *BEAN, "event_id", "is_batch", "is_shared_id", "outcome")
#: Beans of a part that is rewritten rather than kept apart.
_SMALL_PART = 20_000
REUSED_ID = "event ID was reused for a different registry command"


class BeanState:
    """Everything later commands of one bean can depend on."""

    __slots__ = (
        "revision", "status", "track_ts", "created", "updated", "decision", "results", "seen",
    )

    def __init__(self):
        self.revision = 0
        self.status = self.track_ts = self.created = self.updated = None
        self.decision = None  # (id, content hash, ts, acknowledged ts)
        self.results: dict[str, str] = {}
        self.seen: dict[str, str] = {}

    @staticmethod
    def seeded(row: dict) -> "BeanState":
        state = BeanState()
        for name in ("revision", "status", "track_ts", "created", "updated"):
            setattr(state, name, row[name])
        if row["decision_id"] is not None:
            state.decision = tuple(
                row["decision_" + name] for name in ("id", "hash", "ts", "ack")
            )
        return state

    def copy(self) -> "BeanState":
        other = BeanState()
        for name in self.__slots__:
            value = getattr(self, name)
            setattr(other, name, dict(value) if isinstance(value, dict) else value)
        return other


def event_kind(previous: str | None, incoming: str) -> str:
    if previous is None:
        return "bean.created"
    if incoming in (EXITED, CANCELLED):
        return "bean." + incoming
    if previous == TENTATIVE and incoming == CONFIRMED:
        return "bean.confirmed"
    return "track.updated"


def _track(state: BeanState, c: dict):
    if state.revision:
        if c["ts"] < state.track_ts:
            return REJECTED, STALE, "update lies before the last one of this bean", None
        if c["status"] not in TRANSITIONS[state.status]:
            text = f"no step leads from {state.status} to {c['status']}"
            return REJECTED, CONFLICT, text, None
    kind = event_kind(state.status, c["status"])
    if not state.revision:
        state.created = c["first_ts"]
    state.status, state.track_ts = c["status"], c["ts"]
    return APPLIED, None, None, kind


def _enrich(state: BeanState, c: dict):
    known = state.results.get(c["part_id"], c["stored_part_hash"])
    if known is not None:
        if known == c["part_hash"]:
            return NOOP, None, None, None
        return REJECTED, CONFLICT, "same result_id, other content", None
    state.results[c["part_id"]] = c["part_hash"]
    return APPLIED, None, None, "enrichment.added"


def _decide(state: BeanState, c: dict):
    current = state.decision
    if current is not None:
        if current[0] == c["part_id"]:
            if current[1] == c["part_hash"] and current[3] == c["ack_ts"]:
                return NOOP, None, None, None
            return REJECTED, CONFLICT, "same decision_id, other content", None
        if current[3] is not None:
            return REJECTED, CONFLICT, "the open decision is already acknowledged", None
    state.decision = (c["part_id"], c["part_hash"], c["ts"], c["ack_ts"])
    return APPLIED, None, None, "sorting.decision"


def _acknowledge(state: BeanState, c: dict):
    current = state.decision
    if current is None or current[0] != c["part_id"]:
        return REJECTED, CONFLICT, "no open decision has this id", None
    if c["ts"] < current[2]:
        return REJECTED, STALE, "acknowledged before it was decided", None
    if current[3] is not None:
        if current[3] == c["ts"]:
            return NOOP, None, None, None
        text = "acknowledged before, at another moment"
        return REJECTED, CONFLICT, text, None
    state.decision = (*current[:3], c["ts"])
    return APPLIED, None, None, "sorting.acknowledged"


_STEPS = {UPDATE: _track, ENRICH: _enrich, DECIDE: _decide, ACKNOWLEDGE: _acknowledge}


def apply_command(state: BeanState, c: dict) -> tuple:
    """Advance ``state`` by one item; returns the outcome fields."""
    if c["static_error"] is not None:
        kind = CONFLICT if c["problem"] is None else INVALID
        result = (REJECTED, kind, c["static_error"], None)
    elif c["stored_id"] is not None:
        same = c["stored_id"] == SAME
        result = (DUPLICATE, None, None, None) if same else (REJECTED, CONFLICT, REUSED_ID, None)
    elif c["batch_clash"] or c["foreign_claim"]:
        result = (REJECTED, CONFLICT, REUSED_ID, None)
    elif c["event_id"] in state.seen:
        same = state.seen[c["event_id"]] == c["fingerprint"]
        result = (DUPLICATE, None, None, None) if same else (REJECTED, CONFLICT, REUSED_ID, None)
    elif c["op"] != UPDATE and not state.revision:
        result = (REJECTED, NOT_FOUND, "unknown bean", None)
    else:
        result = _STEPS[c["op"]](state, c)
    if result[0] == APPLIED:
        state.revision += 1
        state.updated = c["ts"] if state.updated is None else max(state.updated, c["ts"])
        state.seen[c["event_id"]] = c["fingerprint"]
    return (*result[:3], state.revision, result[3], state.status, state.created, state.updated)


class FoldStream:
    """Consumes bean-sorted items; keeps the running bean and an open batch between calls."""

    def __init__(self):
        self.bean = None
        self.state = BeanState()
        self.batch = None
        self.saved: BeanState | None = None

    def _close_batch(self):
        if self.saved is not None:
            self.state, self.saved = self.saved, None
        self.batch = None

    def feed(self, c: dict) -> tuple:
        bean = (c["run_id"], c["sequence"])
        if bean != self.bean:
            self.bean, self.state, self.saved, self.batch = bean, BeanState(), None, None
        if c["op"] == SEED:
            self.state = BeanState.seeded(c["seed"])
            return (None,) * len(_OUTCOME_NAMES)
        if c["command_seq"] != self.batch:
            self._close_batch()
            self.batch = c["command_seq"]
            if c["batch_failed"]:
                self.saved = self.state.copy()
        return apply_command(self.state, c)


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = FoldStream()
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in _SLIM]
        outcomes = [stream.feed(dict(zip(_SLIM, row))) for row in zip(*columns)]
        if not outcomes:
            continue
        arrays = [
            pa.array(column, kind)
            for column, (_, kind) in zip(zip(*outcomes), _OUTCOME_ARROW)
        ]
        # The command columns pass through untouched as Arrow buffers.
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *arrays], [*batch.schema.names, *_OUTCOME_NAMES]
        )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _fold_once(items: DataFrame) -> DataFrame:
    return (
        spread(items, *BEAN)
        .sortWithinPartitions(*BEAN, "command_seq", "item_no")
        .mapInArrow(_fold_partition, f"{_ddl(items)}, {OUTCOME_FIELDS}")
    )


def _shared_ids(items: DataFrame) -> DataFrame:
    bean = F.struct(*BEAN)
    return (
        items.groupBy("event_id")
        .agg(F.min(bean).alias("_low"), F.max(bean).alias("_high"))
        .where(F.col("_low") != F.col("_high"))
        .select("event_id")
    )


def _with_batch_clash(items: DataFrame) -> DataFrame:
    """Mark batch items whose event id an earlier item of the same batch used differently."""
    key = ["command_seq", "event_id"]
    content = F.struct(*BEAN, "fingerprint")
    doubtful = items.where(F.col("is_batch") & F.col("repeats_id"))
    first = doubtful.groupBy(*key).agg(F.min_by(content, "item_no").alias("_owner"))
    marked = doubtful.join(first, key).withColumn("batch_clash", content != F.col("_owner"))
    plain = items.where(~(F.col("is_batch") & F.col("repeats_id"))).withColumn(
        "batch_clash", F.lit(False)
    )
    return plain.unionByName(marked.drop("_owner")).drop("repeats_id")


def _verdicts(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed batches, and the owner of every event id that several beans use."""
    failed = (
        linked.where(F.col("is_batch") & (F.col("outcome") == REJECTED))
        .select("command_seq").distinct()
    )
    applied = linked.where(F.col("is_shared_id") & (F.col("outcome") == APPLIED)).join(
        failed, "command_seq", "left_anti"
    )
    claims = applied.groupBy("event_id").agg(
        F.min(F.struct("command_seq", "item_no", *BEAN)).alias("claim")
    )
    return failed, claims


def _is_foreign(claim: str) -> Column:
    """Whether an item comes after another bean's claim to its event id."""
    c = F.col(claim)
    mine = (c["run_id"] == F.col("run_id")) & (c["sequence"] == F.col("sequence"))
    later = F.struct(c["command_seq"], c["item_no"]) < F.struct("command_seq", "item_no")
    return F.coalesce(later & ~mine, F.lit(False))


def _touched(
    linked: DataFrame, failed: tuple[DataFrame, DataFrame], claims: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """Beans with an item that the verdicts now mark in another way than before.

    A claim that moves changes the marks of the items between its two places only, not of every bean
    that uses the id.
    """
    before, now = (df.withColumn(name, F.lit(True)) for df, name in zip(failed, ("_before", "_now")))
    moved_batches = before.join(now, "command_seq", "full_outer").where(
        "_before IS NULL OR _now IS NULL"
    )
    before, now = (df.withColumnRenamed("claim", name) for df, name in zip(claims, ("_before", "_now")))
    moved_ids = before.join(now, "event_id", "full_outer").where("NOT (_before <=> _now)")
    return (
        linked.where("is_batch").join(moved_batches, "command_seq", "left_semi").select(*BEAN)
        .unionByName(
            linked.where("is_shared_id").join(moved_ids, "event_id")
            .where(_is_foreign("_before") != _is_foreign("_now"))
            .select(*BEAN)
        )
        .distinct()
    )


def _flagged(items: DataFrame, failed: DataFrame, claims: DataFrame) -> DataFrame:
    shared = items.where("is_shared_id").join(claims, "event_id", "left")
    marked = shared.withColumn("foreign_claim", _is_foreign("claim")).select(
        *items.columns, "foreign_claim"
    )
    plain = items.where("NOT is_shared_id").withColumn("foreign_claim", F.lit(False))
    flagged = plain.unionByName(marked)
    batches = flagged.where("is_batch").join(
        failed.withColumn("_failed", F.lit(True)), "command_seq", "left"
    ).withColumn("batch_failed", F.coalesce("_failed", F.lit(False))).drop("_failed")
    return flagged.where("NOT is_batch").withColumn("batch_failed", F.lit(False)).unionByName(
        batches.select(*flagged.columns, "batch_failed")
    )


def _seed_rows(seeds: DataFrame, like: DataFrame) -> DataFrame:
    """One row per bean ahead of all commands, with the columns of the items."""
    given = {
        "run_id": F.col("run_id"), "sequence": F.col("sequence"), "seed": F.col("seed"),
        "op": F.lit(SEED), "command_seq": F.lit(-(1 << 62)), "item_no": F.lit(0),
        "is_batch": F.lit(False), "repeats_id": F.lit(False),
    }
    return seeds.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def fold_commands(items: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Outcome of every command item, as if all commands had run one after the other.

    The iteration only moves the narrow columns the rules look at; payloads stay in one written
    table and meet their outcome in a single join at the end.

    To continue an earlier fold, ``seeds`` holds ``run_id``, ``sequence`` and ``seed``
    (``SEED_STATE``) of the beans it left, and items carry ``stored_id`` (``same`` or ``other`` where
    it accepted their event id) and ``stored_part_hash`` (where it accepted their result id).
    """
    items = durable(items)
    return with_outcomes(items, settle(items, seeds))


def with_outcomes(items: DataFrame, settled: DataFrame) -> DataFrame:
    """Whole items with what ``settle`` found, and any columns added to it."""
    used_up = ("repeats_id", "problem", "static_error", *_STORED)
    return items.drop(*used_up).join(settled, ["command_seq", "item_no"])


def settle(items: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``command_seq``, ``item_no`` and outcome of every item of ``fold_commands``; items are read more than once."""
    missing = {n: F.lit(None).cast(kind) for n, kind in _STORED.items() if n not in items.columns}
    slim = items.withColumns(missing).select(*_ITEM_COLUMNS)
    if seeds is not None:
        slim = slim.unionByName(_seed_rows(seeds, slim))
    shared = _shared_ids(slim).withColumn("_shared", F.lit(True))
    carried = durable(
        _with_batch_clash(
            slim.join(shared, "event_id", "left")
            .withColumn("is_shared_id", F.coalesce("_shared", F.lit(False)))
            .drop("_shared")
        )
    )
    static = carried.where(
        F.col("is_batch") & (F.col("static_error").isNotNull() | F.col("batch_clash"))
    ).select("command_seq").distinct()
    failed = durable(static)
    claims = durable(
        carried.where(F.col("is_shared_id") & F.col("static_error").isNull())
        .groupBy("event_id")
        .agg(F.min(F.struct("command_seq", "item_no", *BEAN)).alias("claim"))
    )
    parts = [_Part(durable(_fold_once(_flagged(carried, failed, claims))))]
    while True:
        linked = durable(
            _newest(parts).where("is_batch OR is_shared_id").select(*_LINKED)
        )
        now_failed, now_claims = (durable(df) for df in _verdicts(linked))
        touched = durable(_touched(linked, (failed, now_failed), (claims, now_claims)))
        failed, claims, count = now_failed, now_claims, touched.count()
        if not count:
            return _settle_batches(_newest(parts).where(F.col("op") != SEED)).select(
                "command_seq", "item_no", *_OUTCOME_NAMES
            )
        again = _fold_once(_flagged(carried.join(touched, BEAN, "left_semi"), failed, claims))
        _fold_again(parts, again, touched, count)


@dataclass(frozen=True)
class _Part:
    """Folded items: of all beans, or of ``beans``, whose rows in earlier parts no longer hold."""

    folded: DataFrame
    beans: DataFrame | None = None
    count: int = 0


def _newest(parts: list[_Part]) -> DataFrame:
    """The rows of every bean from the last part that has it."""
    rows = parts[0].folded
    for part in parts[1:]:
        rows = rows.join(part.beans, BEAN, "left_anti").unionByName(part.folded)
    return rows


def _fold_again(parts: list[_Part], again: DataFrame, touched: DataFrame, count: int) -> None:
    """Add a part. Parts that are not much larger are merged into it, so there are few, and large ones stay."""
    merged = []
    while len(parts) > 1 and parts[-1].count <= max(2 * count, _SMALL_PART):
        merged.insert(0, parts.pop())
        count += merged[0].count
    beans = touched
    for part in merged:
        beans = beans.unionByName(part.beans)
    newest = _newest([*merged, _Part(again, touched)])
    parts.append(_Part(durable(newest), durable(beans.distinct()) if merged else touched, count))


def _settle_batches(folded: DataFrame) -> DataFrame:
    """Items of a failed batch: the first failure keeps its error, the others are rolled back."""
    first = (
        folded.where(F.col("is_batch") & (F.col("outcome") == REJECTED))
        .groupBy("command_seq")
        .agg(F.min("item_no").alias("_first"))
    )
    batches = folded.where("is_batch").join(first, "command_seq", "left")
    rolled = F.col("_first").isNotNull() & (F.col("item_no") != F.col("_first"))
    clear = {
        name: F.when(~rolled, F.col(name))
        for name in ("error_type", "error_message", "kind", "revision")
    }
    settled = batches.withColumns(
        {**clear, "outcome": F.when(rolled, F.lit(ROLLED_BACK)).otherwise(F.col("outcome"))}
    ).drop("_first")
    return folded.where("NOT is_batch").unionByName(settled.select(*folded.columns))


def journal(folded: DataFrame, block_width: int = 65_536) -> DataFrame:
    """Accepted commands with a dense global ``stream_sequence`` in command order."""
    return number_rows(
        folded.where(F.col("outcome") == APPLIED),
        [],
        ["command_seq", "item_no"],
        "stream_sequence",
        block_width=block_width,
    )


def command_results(folded: DataFrame) -> DataFrame:
    """One answer per command: the worst item decides."""
    bad = F.col("outcome") == REJECTED
    return folded.groupBy("command_seq", "request_id").agg(
        F.bool_and(~bad).alias("ok"),
        F.min(F.when(bad, F.struct("item_no", "error_type", "error_message"))).alias("_e"),
        F.count_if(F.col("outcome") == APPLIED).alias("applied"),
    ).select(
        "command_seq", "request_id", "ok", "applied",
        F.col("_e.error_type").alias("error_type"),
        F.col("_e.error_message").alias("error_message"),
    )
