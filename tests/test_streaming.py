import tempfile

import pytest
from pyspark.sql import functions as F

from flightline.operators.tracking import track
from flightline.plans import fixtures as fx
from flightline.registry import commands, fold
from flightline.registry import queries as ask
from flightline.streaming import registry as stream_registry
from flightline.streaming.tracker import frame_rows, track_stream


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(
        key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    yield spark
    spark.conf.unset(key)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write_ordered(df, column, parts):
    """One file per slice of the order column, oldest first."""
    path = folder()
    for i, (low, high) in enumerate(parts):
        part = df.where(F.col(column).between(low, high)).coalesce(1)
        part.write.mode("append").parquet(path)
    return path


def run(query_df, name):
    query = (
        query_df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", folder()).trigger(availableNow=True).start()
    )
    query.awaitTermination(200)
    assert query.exception() is None
    return query_df.sparkSession.table(name)


def test_streamed_tracker_equals_batch(rocks, sf_dir):
    observed = fx.observations(rocks, sf_dir).where("run_id IN ('1', '2')").cache()
    timeline = fx.timeline(rocks, sf_dir).where("run_id IN ('1', '2')").cache()
    frames = frame_rows(observed, timeline)
    path = write_ordered(frames, "frame_index", [(0, 900), (901, 10_000)])
    stream = rocks.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path)
    columns = ["run_id", "sequence", "frame_index", "status", "hits", "misses", "x_mm", "vy_mm_s"]
    got = run(track_stream(stream, fx.VIEW), "tracked").where("row_kind = 'track'").select(*columns)
    want = track(observed, timeline, fx.VIEW).snapshots.select(*columns)
    assert got.count() > 1000
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_streamed_fold_equals_batch_and_feeds_a_journal(rocks, sf_dir):
    log = fx.command_log(rocks, sf_dir).cache()
    path = write_ordered(log, "command_seq", [(0, 1400), (1401, 100_000)])
    stream = rocks.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = folder() + "/journal"
    query = (
        stream_registry.fold_stream(stream).writeStream
        .foreachBatch(stream_registry.journal_writer(rocks, out))
        .option("checkpointLocation", folder()).trigger(availableNow=True).start()
    )
    query.awaitTermination(200)
    assert query.exception() is None
    got = rocks.read.parquet(out)
    columns = ["run_id", "sequence", "event_id", "kind", "revision"]
    want = fold.journal(fold.fold_commands(commands.command_items(commands.parse_commands(log))))
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty()
    assert got.count() == want.count()
    assert ask.journal_gaps(got).isEmpty()
    assert not ask.journal_gaps(got.where("stream_sequence NOT IN (5, 6)")).isEmpty()
    assert stream_registry.cross_run_ids(got).isEmpty()
    seen = []
    events = rocks.readStream.schema(got.schema).parquet(out)
    checkpoint = folder()
    for _ in range(2):
        stream_registry.consume_journal(
            ask.by_topic(events, "bean."), lambda batch: seen.append(batch.count()), checkpoint
        ).awaitTermination(100)
    assert sum(seen) == got.where("kind LIKE 'bean.%'").count()
