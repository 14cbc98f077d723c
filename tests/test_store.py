"""The stored registry: parts of a log, replays, unfinished versions and rival writers."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from flightline.plans import fixtures
from flightline.plans.durable import durable
from flightline.registry import commands, fold, store as stored, tables
from flightline.registry.queries import HistoryGap
from flightline.registry.store import RegistryStore, start_cursor

OUTCOME = ["command_seq", "item_no", "outcome", "error_type", "revision", "kind", "bean_status", "created_ts", "updated_ts"]


def rows(df, columns=None):
    found = map(tuple, (df if columns is None else df.select(*columns)).collect())
    return sorted(found, key=lambda r: (r[0], repr(r)) if isinstance(r[0], int) else repr(r))


def plain(df):
    return df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct") else c for c in df.columns])


@pytest.fixture(scope="module", params=[False, True], ids=["single", "batches"])
def parts(request, spark, tmp_path_factory):
    """The whole log folded at once, and the same log in three parts through a store."""
    log = fixtures.command_log(spark, "/root/testdata/sf0.001", batches=request.param)
    items = commands.command_items(commands.parse_commands(log)).cache()
    low, high = items.agg(F.expr("percentile_approx(command_seq, array(0.3, 0.7))")).first()[0]
    store = RegistryStore.create(spark, str(tmp_path_factory.mktemp("store")), buckets=4)
    seq = F.col("command_seq")
    done = [store.apply(items.where(part)) for part in (seq <= low, (seq > low) & (seq <= high), seq > high)]
    once = fold.fold_commands(items).cache()
    return items, once, store, done


def test_outcomes_do_not_depend_on_the_parts(parts):
    _, once, _, done = parts
    assert rows(done[0].unionByName(done[1]).unionByName(done[2]), OUTCOME) == rows(once, OUTCOME)


@pytest.mark.parametrize("name", list(tables.TABLES))
def test_tables_do_not_depend_on_the_parts(parts, name):
    _, once, store, _ = parts
    whole = tables.normalise(fold.journal(once))[name]
    assert rows(plain(store.table(name).select(*whole.columns))) == rows(plain(whole))


def test_earlier_versions_stay_readable(parts):
    _, once, store, done = parts
    whole = fold.journal(done[0])
    assert rows(store.table("beans", version=1)) == rows(tables.beans(whole))
    assert store.version() == 3 and store.table("beans", version=0) is None


def test_replay_unfinished_version_and_rival_writer(parts, spark):
    items, once, store, _ = parts
    before, version = rows(store.table("beans")), store.version()
    # A job that died has written files but no manifest.
    store.table("beans").write.parquet(f"{store._path}/beans/version={version + 1}/bucket=0")
    assert rows(store.table("beans")) == before
    accepted = once.where("outcome = 'applied'").select("command_seq", "item_no")
    again = store.apply(items.join(accepted, ["command_seq", "item_no"], "left_semi"))
    # Batches that failed at first fail again on their own; whatever was accepted is a duplicate.
    assert {r[0] for r in again.select("outcome").distinct().collect()} == {"duplicate"}
    assert store.version() == version + 1 and rows(store.table("beans")) == before
    with pytest.raises(AnalysisException):
        store._publish(version + 1, [(None, None, None, 0, 4, 1)])


def test_a_cursor_below_the_floor_is_refused_and_a_killed_consumer_ends_equal(parts, spark, tmp_path):
    _, _, store, _ = parts
    whole = rows(store.table("registry_events"), ["stream_sequence", "event_id"])
    store.retire(11)
    with pytest.raises(HistoryGap):
        store.events_after(9)
    with pytest.raises(ValueError, match="after the next event"):
        store.retire(10**9)
    assert rows(store.events_after(10, limit=2), ["stream_sequence"]) == [(11,), (12,)]
    assert store.events_after(len(whole)).count() == 0
    cursor, seen, calls = str(tmp_path / "cursor"), str(tmp_path / "seen"), []

    def handle(page):
        page.select("stream_sequence", "event_id").write.mode("append").parquet(seen)
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt  # killed after the page was handled, before the cursor was stored

    start_cursor(spark, cursor, 10)
    with pytest.raises(KeyboardInterrupt):
        store.consume(cursor, handle, limit=200)
    assert store.consume(cursor, handle, limit=200) == len(whole)
    assert rows(spark.read.parquet(seen).distinct()) == whole[10:]


def test_an_empty_part_publishes_an_empty_version(spark, tmp_path):
    log = spark.createDataFrame([], "command_seq bigint, value string")
    store = RegistryStore.create(spark, str(tmp_path), buckets=2)
    assert store.apply(commands.command_items(commands.parse_commands(log))).count() == 0
    assert store.version() == 1 and store.table("beans").count() == 0


def test_a_version_writes_payloads_once_beside_its_input(spark, sf_dir, tmp_path, monkeypatch):
    log = fixtures.command_log(spark, sf_dir).where("command_seq < 300")
    items = durable(commands.command_items(commands.parse_commands(log)))
    written = []
    for module in (stored, fold):
        monkeypatch.setattr(module, "durable", lambda df: written.append("track" in df.columns) or durable(df))
    registry = RegistryStore.create(spark, str(tmp_path / "registry"), buckets=2)
    given = registry.apply(items)
    assert written.count(True) == 2
    written.clear()
    again = registry.apply(items, reread=True)
    assert written.count(True) == 1
    assert given.columns == again.columns == fold.fold_commands(items).columns
    assert given.count() == again.count() == items.count()
