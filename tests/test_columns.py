"""Prediction, calibration, detection, sources and documents on small inputs."""

import json
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.functions.mathx import erf
from flightline.operators import analytics, background, calibration, detection, imaging, prediction
from flightline.plans import fixtures as fx
from flightline.settings import DetectorSettings, GateLayout, SettingsError, TrackerSettings
from flightline.sources import export
from flightline.sources import recordings as rec


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_erf_matches_the_library(spark):
    rows = spark.range(-700, 701).select((F.col("id") / 100.0).alias("x"))
    for x, value in rows.select("x", erf(F.col("x"))).collect():
        assert value == pytest.approx(math.erf(x), abs=1e-14)


def test_central_fall_selects_the_centre_gate(spark):
    state = spark.createDataFrame(
        [("r", 1, 1, 0, "confirmed", 0.0, 0.0, 0.0, 900.0, 0.04, 0.0, 25.0),
         ("r", 2, 1, 0, "exited", 0.0, 0.0, 0.0, 900.0, 0.04, 0.0, 25.0)],
        "run_id string, sequence bigint, frame_index bigint, timestamp_ns bigint, status string, "
        "x_mm double, y_mm double, vx_mm_s double, vy_mm_s double, p_pos double, p_cross double, "
        "p_vel double",
    )
    layout = GateLayout(67.0)
    found = prediction.with_best_gate(prediction.predict(state, layout)).collect()
    assert len(found) == 1 and found[0].seconds_until_crossing < 0.1
    assert found[0].best_label == "G0" and found[0].best_probability > 0.4
    assert found[0].selected_gate_indices == [0] and len(found[0].gates) == 21
    long = prediction.gate_rows(prediction.crossings(state, layout), layout, ["sequence"]).collect()
    assert [r.probability for r in long] == pytest.approx([g.probability for g in found[0].gates])
    with pytest.raises(SettingsError):
        GateLayout(67.0, gate_count=20)


def _document(domain="undistorted", noise=0.0):
    rng = np.random.default_rng(3)
    points = [
        [100 + 50 * c + float(rng.normal(0, noise)) if noise else 100.0 + 50 * c,
         75 + 50 * r + float(rng.normal(0, noise)) if noise else 75.0 + 50 * r]
        for r in range(4) for c in range(5)
    ]
    return json.dumps(
        {"schema": "pinkplane-homography/v2", "mapping": {"coordinate_domain": domain},
         "correspondence": {"row_counts": [5] * 4, "mean_CamL_points_px": points}}
    ), points


def test_calibration_fit_and_rejections(spark):
    exact, _ = _document()
    noisy, points = _document(noise=0.5)
    bad, _ = _document(domain="distorted")
    raw = spark.createDataFrame(
        [("exact", exact), ("noisy", noisy), ("bad", bad), ("junk", "[]")],
        "calibration_id string, value string",
    )
    checked = calibration.check_documents(raw)
    problems = {r.calibration_id: r.problem for r in checked.collect()}
    assert problems["exact"] is None and "undistorted" in problems["bad"] and problems["junk"]
    fitted = {
        r.calibration_id: r
        for r in calibration.fit_homographies(
            calibration.grid_points(checked), image_size_px=(400, 300)
        ).collect()
    }
    good = fitted["exact"]
    assert set(fitted) == {"exact", "noisy"} and good.rms_error_mm < 1e-6
    assert good.px_to_mm[0] == pytest.approx(9.16 / 50)
    forward, back = (np.reshape(m, (3, 3)) for m in (good.px_to_mm, good.mm_to_px))
    assert forward @ back / (forward @ back)[2, 2] == pytest.approx(np.eye(3), abs=1e-9)
    centre = forward @ [199.5, 149.5, 1]
    assert centre[:2] / centre[2] == pytest.approx([0, 0], abs=1e-9)
    # The fit is a minimum of the reprojection error: small changes of any entry make it worse.
    grid = np.array([(c * 9.16, r * 9.16) for r in range(4) for c in range(5)])
    noisy_fit = fitted["noisy"]
    matrix = np.reshape(noisy_fit.px_to_mm, (3, 3))
    homogeneous = np.column_stack((np.array(points), np.ones(20)))

    def error(m):
        mapped = homogeneous @ m.T
        difference = mapped[:, :2] / mapped[:, 2:] - grid
        return float(np.sum((difference - difference.mean(axis=0)) ** 2))

    base = error(matrix)
    assert noisy_fit.rms_error_mm < noisy_fit.max_error_mm
    for i in range(8):
        for sign in (1, -1):
            moved = matrix.copy().reshape(-1)
            moved[i] += sign * max(abs(moved[i]), 1e-6) * 1e-3
            assert error(moved.reshape(3, 3)) > base - 1e-9


def _frame(run, index, image):
    return (run, index, image.shape[0], image.shape[1], bytearray(image.tobytes()))


def test_ellipse_is_detected_and_explained(spark):
    ground = np.full((180, 240, 3), 40, dtype=np.uint8)
    y, x = np.mgrid[:180, :240]
    image = ground.copy()
    image[((x - 120) / 35.0) ** 2 + ((y - 90) / 30.0) ** 2 <= 1] = (90, 160, 200)
    schema = "run_id string, frame_index bigint, height int, width int, bgr binary"
    frames = spark.createDataFrame(
        [_frame("r", 0, image), _frame("r", 1, ground), _frame("s", 0, image),
         ("r", 2, 180, 240, bytearray(b"short"))], schema
    )
    plain = spark.createDataFrame([_frame("r", 0, ground)], schema).drop("frame_index")
    parts = detection.detect_components(frames, plain)
    found = detection.detections(parts).collect()
    assert len(found) == 1
    assert (found[0].cx_px, found[0].cy_px) == pytest.approx((120, 90), abs=2)
    assert found[0].solidity > 0.9 and found[0].red > found[0].blue
    troubles = {(r.run_id, r.frame_index) for r in detection.quarantine(parts).collect()}
    assert troubles == {("r", 2), ("s", 0)}
    stages = detection.explain_stages(frames.where("frame_index = 0 AND run_id = 'r'"), plain)
    keys = [r.stage_key for r in stages.orderBy("stage_no").collect()]
    assert keys == list(detection.STAGE_KEYS)
    with pytest.raises(SettingsError):
        DetectorSettings(blur_kernel=4)


def test_image_steps_on_known_shapes():
    square = np.zeros((9, 9), dtype=bool)
    square[2:7, 2:7] = True
    assert imaging.outline_area(square) == 16.0
    assert imaging.dilate(square, 3, 1).sum() == 45 and imaging.erode(square, 3, 1).sum() == 9
    ring = square.copy()
    ring[4, 4] = False
    ring[0, 0] = True
    runs = imaging.foreground_runs(ring)
    assert sorted(np.bincount(imaging.label_runs(runs)).tolist())[-1] > 1
    colour = np.zeros((9, 9, 3), dtype=np.uint8)
    areas = sorted(part["area"] for part in imaging.components(ring, colour))
    assert areas == [1, 24]
    assert imaging.blur(np.full((5, 5), 77, np.uint8), 5).tolist() == np.full((5, 5), 77).tolist()
    assert imaging.shrink(np.full((6, 9, 3), 8, np.uint8), 0.4).tolist()[0][0] == [8, 8, 8]


def test_background_candidates_and_verdicts(spark):
    runs = spark.createDataFrame([("a", 1100), ("b", 3)], "run_id string, frame_count bigint")
    drawn = background.stratified_candidates(runs, 11, seed=12345)
    rows = [r for r in drawn.collect() if r.run_id == "a"]
    assert len(rows) == 44 and len({r.frame_index for r in rows}) == 44
    assert all(r.stratum == r.frame_index // 100 for r in rows)
    assert drawn.where("run_id = 'b'").count() == 3
    again = background.stratified_candidates(runs, 11, seed=12345)
    assert drawn.exceptAll(again).isEmpty()
    verdicts = drawn.select("run_id", "frame_index", (F.col("stratum") != 4).alias("accepted"))
    kept = background.accept_candidates(drawn, verdicts, 11)
    assert kept.where("run_id = 'a'").count() == 11
    row = background.provenance(kept, "stratified median", 12345).where("run_id = 'a'").first()
    assert len(row.frame_indices) == 11 and row.candidate_seed == 12345


def test_recording_sources(spark):
    import pathlib

    root = pathlib.Path(folder())
    for name, body in {
        "one/pairs.csv": "pair,left_timestamp_ns\n0,100\n1,33333500\n2,66667200\n",
        "one/CamL-calibrated.mkv": "x", "one/postprocess/CamL-calibrated.mkv": "x",
        "two/pairs.csv": "left_timestamp_ns\n5\n5\n", "two/CamL-calibrated.mkv": "x",
        "one/homography.json": "{}", "three/notes.txt": "x",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    files = rec.list_files(spark, str(root))
    chosen = {r.recording: r for r in rec.resolve_recordings(files).collect()}
    assert chosen["one"].path == "postprocess/CamL-calibrated.mkv"
    assert chosen["two"].path == "CamL-calibrated.mkv" and chosen["three"].problem
    reports = spark.createDataFrame(
        [("two", '{"homography": {"path": "pairs.csv"}}'), ("three", '{"homography": "gone"}')],
        "recording string, value string",
    )
    maps = {r.recording: r.calibration_path for r in rec.resolve_calibrations(files, reports).collect()}
    assert maps == {"one": "homography.json", "two": "pairs.csv", "three": None}
    lines = rec.sidecar_lines(spark, str(root / "*" / "pairs.csv")).withColumn(
        "run_id", F.element_at(F.split("path", "/"), -2)
    )
    valid = {r.run_id: r.is_valid for r in rec.check_sidecars(lines, ["run_id"]).collect()}
    assert valid == {"one": True, "two": False}
    runs = spark.createDataFrame(
        [("one", 640, 480, 3, 30.0), ("two", 640, 480, 2, 30.0), ("bad", 0, 480, 2, 30.0)],
        "run_id string, width int, height int, frame_count bigint, fps double",
    )
    times = rec.frame_timeline(runs, lines).orderBy("run_id", "frame_index").collect()
    assert [(r.run_id, r.timestamp_ns, r.exact_timestamps) for r in times] == [
        ("one", 100, True), ("one", 33333500, True), ("one", 66667200, True),
        ("two", 0, False), ("two", 33333333, False),
    ]


def test_latency_uses_a_real_element(spark):
    frames = spark.range(40).select(F.lit("r").alias("run_id"), F.col("id").cast("double").alias("processing_ms"))
    row = analytics.latency_summary(frames, ["run_id"]).first()
    assert (row.frames, row.mean_ms, row.p95_ms) == (40, 19.5, 37.0)
    a = analytics.tag_settings(frames, TrackerSettings())
    b = analytics.tag_settings(frames, TrackerSettings(confirmation_hits=3))
    assert analytics.union_results(a, a).count() == 80
    with pytest.raises(analytics.MixedSettings):
        analytics.union_results(a, b)


def test_record_documents_are_validated(spark, sf_dir):
    track = fx._event_columns(spark, sf_dir).limit(3).select(
        fx._track_document(F.col("sequence"), F.lit("confirmed")).alias("track"), "run_id", "sequence", "ts"
    )
    record = F.struct(
        F.col("track.bean_ref").alias("bean_ref"), F.lit(1).alias("revision"),
        F.lit("confirmed").alias("status"), F.col("ts").alias("created_timestamp_ns"),
        F.col("ts").alias("updated_timestamp_ns"), "track",
    )
    good = track.select(F.to_json(record).alias("value"))
    assert export.decode_records(good).where("problem IS NULL").count() == 3
    broken = good.select(F.regexp_replace("value", '"state":\\[[^]]*\\]', '"state":[1,2]').alias("value"))
    assert "4 values" in export.decode_records(broken).first().problem
    other = good.select(F.regexp_replace("value", '^\\{"bean_ref":\\{"run_id":"[^"]*"', '{"bean_ref":{"run_id":"other"').alias("value"))
    assert "another bean" in export.decode_records(other).first().problem


def test_run_export_writes_header_and_frames(spark):
    headers = export.run_headers(
        spark.createDataFrame(
            [("r", "/v.mkv", True, "single frame", [3], 7)],
            "run_id string, source_path string, exact_timestamps boolean, method string, "
            "frame_indices array<int>, candidate_seed bigint",
        ),
        spark.createDataFrame([("r", 2.0, 3.0)], "run_id string, mean_ms double, p95_ms double"),
    )
    frames = spark.createDataFrame(
        [("r", 1, '{"frame_index":1}'), ("r", 0, '{"frame_index":0}')],
        "run_id string, frame_index bigint, document string",
    )
    document = json.loads(export.run_documents(headers, frames).first().document)
    assert [f["frame_index"] for f in document["frames"]] == [0, 1]
    assert document["performance"]["p95_processing_ms"] == 3.0
    path = folder() + "/out"
    export.export_runs(headers, frames, path)
    lines = [r.value for r in spark.read.text(path + "/run_id=r").collect()]
    assert len(lines) == 3 and json.loads(lines[0])["schema"] == export.RUN_SCHEMA
    # Another run leaves the first one, the same run replaces its own lines.
    other = headers.withColumn("run_id", F.lit("q"))
    export.export_runs(other, frames.limit(0), path)
    export.export_runs(headers, frames.where("frame_index = 0"), path)
    assert spark.read.text(path + "/run_id=r").count() == 2 and spark.read.text(path + "/run_id=q").count() == 1


def test_what_cannot_be_computed_keeps_a_row(spark):
    points = spark.createDataFrame(
        [("line", float(i), 5.0, float(i), 1.0) for i in range(3)]
        + [("plate", x * 50.0, y * 40.0, float(x), float(y)) for x in range(4) for y in range(4)],
        "calibration_id string, px double, py double, gx double, gy double",
    )
    fitted = {r.calibration_id: r for r in calibration.fit_homographies(points).collect()}
    assert fitted["line"].problem and fitted["line"].px_to_mm is None
    assert fitted["plate"].problem is None and fitted["plate"].rms_error_mm < 1e-6
    frames = spark.createDataFrame(
        [("even", 0, 2, 2, bytearray([1] * 12)), ("even", 1, 2, 2, bytearray([3] * 12)),
         ("even", 2, 2, 2, bytearray([2] * 12)), ("odd", 0, 2, 2, bytearray(12)), ("odd", 1, 1, 2, bytearray(6))],
        "run_id string, frame_index bigint, height int, width int, bgr binary",
    )
    images = {r.run_id: r for r in background.temporal_median(frames).collect()}
    assert bytes(images["even"].bgr) == bytes([2] * 12) and images["even"].problem is None
    assert images["odd"].bgr is None and images["odd"].problem
