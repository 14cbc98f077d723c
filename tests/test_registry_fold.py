import json

import pytest
from pyspark.sql import functions as F

from flightline.plans import fixtures
from flightline.plans.durable import durable
from flightline.registry import commands, fold
from sequential_registry import Registry


@pytest.mark.parametrize("batches", [False, True])
def test_fold_equals_sequential_registry(spark, sf_dir, batches):
    log = fixtures.command_log(spark, sf_dir, batches=batches)
    parsed = commands.parse_commands(log)
    assert commands.command_errors(parsed).count() == 0
    folded = fold.fold_commands(commands.command_items(parsed)).cache()
    got = {
        (r["command_seq"], r["item_no"]): r["outcome"]
        + ("" if r["outcome"] != "rejected" else ":" + r["error_type"])
        for r in folded.select("command_seq", "item_no", "outcome", "error_type").collect()
    }
    model, want = Registry(), {}
    for row in log.orderBy("command_seq").collect():
        for i, outcome in enumerate(model.run(json.loads(row["value"]))):
            want[(row["command_seq"], i)] = outcome
    assert got == want
    kinds = set(got.values())
    assert {"applied", "duplicate", "noop", "rejected:conflict", "rejected:stale",
            "rejected:not_found"} <= kinds
    if batches:
        assert "rolled_back" in kinds
    rows = fold.journal(folded).orderBy("stream_sequence").collect()
    assert [r["stream_sequence"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r["event_id"], r["kind"], r["run_id"], r["sequence"], r["revision"]) for r in rows] == model.journal


def test_replay_of_the_log_only_finds_duplicates(spark, sf_dir):
    log = fixtures.command_log(spark, sf_dir)
    twice = log.unionByName(log.withColumn("command_seq", F.col("command_seq") + 10_000_000))
    folded = fold.fold_commands(commands.command_items(commands.parse_commands(twice)))
    first_applied = (
        folded.where("command_seq < 10000000 AND outcome = 'applied'")
        .select((F.col("command_seq") + 10_000_000).alias("command_seq"))
    )
    again = folded.join(first_applied, "command_seq", "left_semi")
    assert {r[0] for r in again.select("outcome").distinct().collect()} == {"duplicate"}


def test_a_moved_claim_touches_only_the_beans_between_its_places(spark):
    linked = spark.range(1, 31).selectExpr(
        "id command_seq", "0 item_no", "'r' run_id", "id sequence", "'shared' event_id", "false is_batch",
        "true is_shared_id", "'applied' outcome",
    )
    none = linked.where("is_batch").select("command_seq")

    def claim(*seqs):
        rows = linked.where(F.col("command_seq").isin(*seqs))
        return rows.select("event_id", F.struct("command_seq", "item_no", *fold.BEAN).alias("claim"))

    def touched(before, now):
        return {r.sequence for r in fold._touched(linked, (none, none), (before, now)).collect()}

    assert touched(claim(2), claim(4)) == touched(claim(4), claim(2)) == {3, 4}
    assert touched(claim(2), claim(2)) == set()
    assert touched(claim(28), claim(0)) == {29, 30}


def test_parts_kept_apart_or_merged_give_the_same_fold(spark, sf_dir, monkeypatch):
    log = durable(fixtures.command_log(spark, sf_dir, batches=True))
    items = durable(commands.command_items(commands.parse_commands(log)))
    merged = fold.fold_commands(items).select("command_seq", "item_no", "outcome", "revision")
    monkeypatch.setattr(fold, "_SMALL_PART", 0)
    apart = fold.fold_commands(items).select("command_seq", "item_no", "outcome", "revision")
    assert merged.exceptAll(apart).isEmpty() and apart.exceptAll(merged).isEmpty()


def test_commands_are_written_and_parsed_by_all_tasks(spark, sf_dir):
    log = fixtures.command_log(spark, sf_dir)
    assert log.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
