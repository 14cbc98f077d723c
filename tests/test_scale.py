"""Plans and job counts that decide how queries grow with their input."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightline.operators import background, chain, detection, segments
from flightline.operators.tracking import Tracking, track
from flightline.plans import fixtures as fx
from flightline.plans.durable import durable
from flightline.plans.queries import QUERIES, tracked
from flightline.registry import store, tables as reg


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calibration_fit_joins_nothing(spark, sf_dir):
    plan = plan_of(QUERIES["fit_quality"](spark, sf_dir))
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_timeline_is_not_broadcast(spark, sf_dir):
    plan = plan_of(QUERIES["timeline_exact_nominal"](spark, sf_dir))
    assert "SortMergeJoin [run_id" in plan


def test_snapshots_are_numbered_where_they_are(spark, sf_dir):
    result = tracked(spark, sf_dir)
    numbered = result.snapshots
    assert "Exchange hashpartitioning" not in plan_of(numbered)
    columns = ["run_id", "birth_frame", "birth_ord", "frame_index", "sequence"]
    ranked = Tracking(result.raw).snapshots.select(*columns)
    assert numbered.count() > 10_000
    assert numbered.select(*columns).exceptAll(ranked).isEmpty()


def test_segments_move_their_rows_once(spark, sf_dir):
    rows = segments.assign_segments(fx.observations(spark, sf_dir), fx.timeline(spark, sf_dir), 2)
    assert rows.collect()
    final = plan_of(rows).split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_a_consumer_reads_the_journal_once_for_many_pages(spark, tmp_path, monkeypatch):
    fields = reg.EVENT_FIELDS
    schema = fields if isinstance(fields, T.StructType) else T.StructType.fromDDL(fields)
    columns = [
        F.col("id").cast("long").alias(f.name) if f.name == "stream_sequence" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    stored = store.RegistryStore.create(spark, str(tmp_path / "registry"), buckets=2)
    written = stored._write("registry_events", spark.range(1, 11).select(*columns), 1, 2)
    stored._publish(1, [*written, (None, None, None, 10, 2, 1)])
    copies, pages = [], []
    monkeypatch.setattr(store, "durable", lambda df: copies.append(1) or durable(df))
    store.start_cursor(spark, str(tmp_path / "cursor"), 1)
    top = stored.consume(
        str(tmp_path / "cursor"), lambda p: pages.append([r[0] for r in p.select("stream_sequence").collect()]), limit=4
    )
    assert top == 10 and pages == [[2, 3, 4, 5], [6, 7, 8, 9], [10]] and len(copies) == 1


def test_frame_commands_are_numbered_where_they_are(spark):
    rows = spark.range(400).selectExpr(
        "CAST(id % 20 AS STRING) run_id", "id div 20 frame_index", "0 row_ord", "1L sequence", "id track",
        "CAST(NULL AS STRING) prediction", "CAST(id AS STRING) event_id",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = chain.frame_commands(rows).select(
            "command_seq", F.get_json_object("value", "$.request_id").alias("request"), F.spark_partition_id().alias("task")
        ).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in log}) > 1
    order = sorted((f, str(r)) for f in range(20) for r in range(20))
    assert [r.request for r in sorted(log)] == [f"frame:{run}:{frame}" for frame, run in order]


def test_stage_images_leave_the_task_in_small_batches():
    frame = bytes(64 * 96 * 3)
    rows = [("r", 0, i, 96, 64, frame) for i in range(-1, 600)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in zip(*rows)], names=["run_id", "_block", "frame_index", "height", "width", "bgr"]
    )
    job = detection._job(detection.DetectorSettings(), detection._stage_rows, detection.STAGE_SCHEMA)
    sizes = [(b.num_rows, b.nbytes) for b in job(iter([batch]))]
    assert sum(n for n, _ in sizes) == 6_000 and max(size for _, size in sizes) < 32 << 20


def test_observations_are_ordered_where_their_items_are(spark, sf_dir):
    plan = plan_of(fx.ordered_observations(spark, sf_dir))
    (moved,) = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "frame_block" in moved and "frame_index" not in moved


def test_draws_of_a_long_stratum_equal_a_plain_ranking(spark):
    runs = spark.createDataFrame([("long", 200_000), ("short", 3)], "run_id string, frame_count bigint")
    drawn = background.stratified_candidates(runs, 2, seed=7)
    assert plan_of(drawn).count("Window [row_number") == 1
    found = {(r.run_id, r.stratum, r.pass_no): r.frame_index for r in drawn.collect()}
    hashed = spark.range(200_000).select("id", F.xxhash64(F.lit(7), F.lit("long"), "id").alias("h"))
    for stratum in (0, 1):
        half = hashed.where(F.floor(F.col("id") / 100_000) == stratum).orderBy("h").limit(4)
        assert [r.id for r in half.collect()] == [found["long", stratum, p] for p in range(4)]
    assert sorted(f for (run, *_), f in found.items() if run == "short") == [0, 1, 2]


def test_the_kernel_puts_out_only_the_columns_asked_for(spark, sf_dir):
    wanted = ["run_id", "row_kind", "frame_index", "det_ord", "obs_y_mm"]
    seen, frames = fx.observed_timeline(spark, sf_dir)
    thin = track(seen, frames, fx.VIEW, materialise=False, columns=wanted).raw
    assert thin.columns == wanted
    whole = tracked(spark, sf_dir).raw.select(*wanted)
    assert durable(thin).exceptAll(whole).isEmpty() and thin.count() == whole.count() > 10_000
