"""Command fold and journal as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.prefix import number_rows
from ..registry.commands import command_items, parse_commands
from ..registry.fold import (
    APPLIED,
    OUTCOME_FIELDS,
    REJECTED,
    ROLLED_BACK,
    BeanState,
    apply_command,
)

_CARRIED = [
    ("run_id", "string"), ("sequence", "bigint"), ("command_seq", "bigint"), ("item_no", "int"),
    ("event_id", "string"), ("op", "string"), ("fingerprint", "string"), ("ts", "bigint"),
]
_RESULT = [part.split(" ") for part in OUTCOME_FIELDS.split(", ")]
OUTPUT_SCHEMA = ", ".join(f"{n} {k}" for n, k in [*_CARRIED, *_RESULT])


def _dump(state: BeanState) -> str:
    return json.dumps({name: getattr(state, name) for name in BeanState.__slots__})


def _restore(text: str | None) -> BeanState:
    state = BeanState()
    if text is not None:
        for name, value in json.loads(text).items():
            setattr(state, name, value)
        if state.decision is not None:
            state.decision = tuple(state.decision)
    return state


class RegistryFold(StatefulProcessor):
    """State per run: one entry per bean and one per accepted event id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.beans = handle.getMapState("beans", "sequence bigint", "state string")
        self.owners = handle.getMapState("owners", "event_id string", "sequence bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802,N803
        items = sorted(
            (
                {n: None if v is None or v != v else v for n, v in zip(part.columns, row)}
                for part in rows
                for row in part.itertuples(index=False, name=None)
            ),
            key=lambda c: (c["command_seq"], c["item_no"]),
        )
        out, start = [], 0
        while start < len(items):
            stop = start + 1
            while stop < len(items) and items[stop]["command_seq"] == items[start]["command_seq"]:
                stop += 1
            out += self._command(items[start:stop])
            start = stop
        names = [n for n, _ in [*_CARRIED, *_RESULT]]
        kinds = {
            n: "Int64" if k == "bigint" else "Int32"
            for n, k in [*_CARRIED, *_RESULT]
            if k in ("bigint", "int")
        }
        yield pd.DataFrame(out, columns=names).astype(kinds)

    def _command(self, items: list[dict]) -> list[tuple]:
        """Apply all items or, when one fails, none of them."""
        beans: dict[int, BeanState] = {}
        claimed: dict[str, int] = {}
        results = []
        failed = None
        for position, c in enumerate(items):
            c["ts"] = None if c["ts"] is None else int(c["ts"])
            c["ack_ts"] = None if c["ack_ts"] is None else int(c["ack_ts"])
            bean = int(c["sequence"])
            if bean not in beans:
                saved = self.beans.getValue((bean,)) if self.beans.containsKey((bean,)) else None
                beans[bean] = _restore(None if saved is None else saved[0])
            owner = claimed.get(c["event_id"])
            if owner is None and self.owners.containsKey((c["event_id"],)):
                owner = self.owners.getValue((c["event_id"],))[0]
            c["foreign_claim"] = owner is not None and owner != bean
            c["batch_clash"], c["stored_id"], c["stored_part_hash"] = False, None, None
            result = apply_command(beans[bean], c)
            results.append(result)
            if result[0] == REJECTED:
                failed = position
                break
            if result[0] == APPLIED:
                claimed[c["event_id"]] = bean
        if failed is None:
            for bean, state in beans.items():
                self.beans.updateValue((bean,), (_dump(state),))
            for event_id, bean in claimed.items():
                self.owners.updateValue((event_id,), (bean,))
        elif len(items) > 1:
            blank = (ROLLED_BACK, None, None, None, None, None, None, None)
            results = [results[failed] if i == failed else blank for i in range(len(items))]
        return [
            (*(c[name] for name, _ in _CARRIED), *result) for c, result in zip(items, results)
        ]

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``command_seq, value`` JSON commands.

    Batches and event ids are scoped to a run here; ids reused by two runs are found by
    ``cross_run_ids`` over the journal and reported. Needs the RocksDB state store.
    """
    items = command_items(parse_commands(log)).select(
        "run_id", "sequence", "command_seq", "item_no", "is_batch", "op", "event_id", "fingerprint",
        "problem", "static_error", "status", "ts", "first_ts", "part_id", "part_hash", "ack_ts",
    )
    return items.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RegistryFold(),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


def journal_writer(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: numbers accepted rows after the earlier batches and appends them.

    Each micro-batch owns one folder, so a retried batch replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            earlier = spark.read.parquet(path).where(F.col("batch") < batch_id)
            offset = earlier.agg(F.max("stream_sequence")).first()[0] or 0
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            offset = 0
        accepted = batch.where(F.col("outcome") == APPLIED)
        numbered = number_rows(accepted, [], ["command_seq", "item_no"], "stream_sequence")
        numbered.withColumn(
            "stream_sequence", F.col("stream_sequence") + F.lit(int(offset))
        ).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def consume_journal(
    events: DataFrame,
    apply: Callable[[DataFrame], None],
    checkpoint: str,
):
    """Consumer recovery loop: the cursor is the query checkpoint and moves after ``apply`` returns,
    so an interrupted batch is delivered again and ``apply`` must be idempotent."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: apply(batch))
        .trigger(availableNow=True)
        .start()
    )


def cross_run_ids(journal: DataFrame) -> DataFrame:
    """Event ids accepted in more than one run."""
    return (
        journal.groupBy("event_id")
        .agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
        .where(F.col("first_run") != F.col("last_run"))
    )
