"""Detections, evaluation, sources and rollup rules on hand-made rows."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlake.operators import detections as D
from flowlake.operators import facts, motion, reports
from flowlake.plans import management, scalars
from flowlake.sources import io


def test_assignment_is_optimal():
    draw = np.random.default_rng(2)
    from itertools import permutations

    for n, m in ((1, 1), (2, 3), (4, 4), (3, 6)):
        cost = draw.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        got = D.assign(cost)
        assert len(got) == n and sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_perfect_tracks_score_one(spark):
    rows = [(1, f, t, 10.0 * t, 10.0, 10.0 * t + 8, 30.0) for f in range(5) for t in (1, 2, 3)]
    truth = spark.createDataFrame(rows, "camera_id long, frame_index long, track_id long, x1 double, y1 double, x2 double, y2 double")
    matched = D.match_frames(D.candidate_pairs(truth, truth, 0.5), 0.5)
    m = D.clear_metrics(truth, truth, matched).first()
    assert (m.mota, m.precision, m.recall, m.id_switches, m.fragments) == (1.0, 1.0, 1.0, 0, 0)
    assert D.idf1(truth, truth, matched).first().idf1 == 1.0 and D.hota(truth, truth).first().hota == pytest.approx(1.0)


def test_suppression_keeps_the_best(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 1, 3, 50.0, 50.0, 60.0, 60.0, 0.5)]
    boxes = spark.createDataFrame(rows, "camera_id long, frame_index long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.box_id for r in D.suppress_overlaps(boxes, 0.5).collect()) == [1, 3]


def test_homography(spark):
    good = [(1, x, y, x / 10, y / 10) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))]
    bad = [(2, float(k), float(k), 0.0, 0.0) for k in range(4)] + [(3, 0.0, 0.0, 0.0, 0.0)]
    got = {r.camera_id: r for r in D.fit_homographies(spark.createDataFrame(good + bad, "camera_id long, ix double, iy double, gx double, gy double")).collect()}
    assert np.allclose(np.array(got[1].homography) / got[1].homography[8], [0.1, 0, 0, 0, 0.1, 0, 0, 0, 1])
    assert got[2].reason == "points are degenerate" and got[3].reason == "fewer than four pairs"


def test_gallery(spark):
    g = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 5), (3, [0.0, 1.0], 5), (4, [1.0, 0.1], 0)], "track_id long, vector array<double>, last_seen long")
    q = spark.createDataFrame([(1, 10, [2.0, 0.1]), (2, 10, [0.0, 3.0]), (3, 10, [-1.0, -1.0]), (4, 10, [0.0, 0.0])], "query_id long, frame long, vector array<double>")
    got = {r.query_id: r.track_id for r in motion.gallery_match(q, g, 0.5, 5).collect()}
    assert got == {1: 1, 2: 3, 3: None, 4: None}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(json.dumps({"frame_index": 0, "timestamp_seconds": 0.5, "tracks": [{"track_id": 7, "xyxy": [1, 2, 3, 4], "confidence": 0.9, "confirmed": True}], "expired_track_ids": [3]}) + "\n" + json.dumps({"frame_index": 1, "timestamp_seconds": 1.0, "tracks": [], "expired_track_ids": []}) + "\n")
    rows = io.read_tracking(spark, str(tmp_path / "t.jsonl"), 4).orderBy("frame_index").collect()
    assert [(r.frame_index, r.track_id, r.x2) for r in rows] == [(0, 7, 3.0), (1, None, None)]
    (tmp_path / "d.jsonl").write_text(json.dumps({"frame_index": 3, "timestamp": 1.5, "detections": [{"xyxy": [1, 2, 3, 4], "confidence": 0.5}]}) + "\n\n" + json.dumps({"frame_index": 4, "timestamp": 2.0, "source_index": 9, "detections": []}) + "\n")
    found = io.read_detections(spark, str(tmp_path / "d.jsonl"))
    assert [(r.source_index, r.class_id, r.class_name) for r in found.orderBy("frame_index").collect()] == [(3, 0, "person"), (9, None, None)]
    io.write_detections(found, str(tmp_path / "out"))
    assert io.read_detections(spark, str(tmp_path / "out")).orderBy("frame_index").collect() == found.orderBy("frame_index").collect()
    (tmp_path / "gt.txt").write_text("# c\n1,5,100,50,20,30,1\n2 5 10 10 40 60\n1,2\n")
    assert [tuple(r) for r in io.read_ground_truth(spark, str(tmp_path / "gt.txt")).orderBy("frame_index").collect()] == [(0, 5, 100.0, 50.0, 120.0, 80.0), (2, 5, 10.0, 10.0, 40.0, 60.0)]


def test_camera_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("camera:\n  id: lobby\nanalytics:\n  restricted_zones:\n    - id: door\n      points: [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2]]\n      entry_dwell_seconds: 1.5\n")
    (tmp_path / "b.yaml").write_text("camera: [")
    got = {r.camera_id: r for r in io.read_camera_configs(spark, str(tmp_path / "*.yaml")).collect()}
    assert got["lobby"].zones[0].id == "door" and got["lobby"].zones[0].settings["entry_dwell_seconds"] == "1.5"
    assert got[None].error


def test_minutes_need_a_time_zone(spark, tmp_path):
    good = {"cameraId": "c", "bucketStart": "2024-01-01T00:00:00Z", "sampleCount": 179, "expectedSamples": 30}
    lines = [good, good | {"bucketStart": "2024-01-01T00:00:00"}, good | {"extra": 1}, good | {"sampleCount": -1}]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "not json\n")
    valid, rejected = io.validate_minutes(io.read_minutes(spark, str(tmp_path / "m.jsonl")))
    assert valid.count() == 1
    assert sorted(r.reasons[0] for r in rejected.collect()) == ["bucket_start", "not_json", "sample_count", "unknown_key"]


def test_periods_and_changes(spark):
    q = reports.Query(start="2024-03-31 00:00:00", end="2024-03-31 00:00:00", comparison="previous_month")
    assert str(spark.range(1).select(reports.compared(q)[0]).first()[0]) == "2024-02-29 00:00:00"
    a, b = (spark.createDataFrame([(0, 0, v)], "x int, y int, value double") for v in (2.0, 5.0))
    assert tuple(reports.difference_points(a, b).first())[2:] == (-3.0, -1.0)


def test_first_and_last_write_win(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 2], "v": [1, 2, 3], "arrival": [1, 2, 3]}))
    assert sorted(r.v for r in facts.upsert_last(rows, ["k"]).collect()) == [2, 3]
    assert [r.v for r in facts.insert_ignore(rows, rows.where("k = 2"), ["k"]).collect()] == [1]


def test_rollup_refresh_replaces_days(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([("field", "1", v)], "location_type string, location_id string, entries long").withColumn("bucket_start", F.lit(d).cast("timestamp"))
    path = str(tmp_path / "hours")
    facts.write_hours(day("2024-01-01 05:00:00", 1).union(day("2024-01-02 05:00:00", 2)), path)
    facts.write_hours(day("2024-01-02 05:00:00", 7), path)
    assert sorted(r.entries for r in spark.read.parquet(path).collect()) == [1, 7]


def test_hota_means_over_pairs_and_keeps_sequences_without_truth(spark):
    """Two pairs of unequal length weigh alike; a camera with detections only is all false positives."""
    box = (0.0, 0.0, 10.0, 10.0)
    far = (50.0, 50.0, 60.0, 60.0)
    schema = "camera_id long, frame_index long, track_id long, x1 double, y1 double, x2 double, y2 double"
    truth = [(1, f, 1, *box) for f in range(10)] + [(1, f, 2, *far) for f in range(10)]
    found = [(1, f, 11, *box) for f in range(10)] + [(1, 0, 12, *far)] + [(2, 0, 13, *box)]
    t, h = spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)
    got = {r.camera_id: r for r in D.hota(t, h).collect()}
    assert got[1].ass_a == pytest.approx((1.0 + 0.1) / 2) and got[1].det_a == pytest.approx(11 / 20)
    assert got[1].hota == pytest.approx((0.55 * 0.55) ** 0.5) and got[2].hota == 0
    clear = {r.camera_id: r for r in D.clear_metrics(t, h, D.match_frames(D.candidate_pairs(t, h, 0.5), 0.5)).collect()}
    assert (clear[2].fp, clear[2].tp, clear[2].precision, clear[2].mota) == (1, 0, 0.0, 0.0) and clear[1].fn == 9
    assert {(r.tracker, r.camera_id) for r in D.compare_trackers(t, {"x": h, "y": t}).collect()} == {("x", 1), ("x", 2), ("y", 1)}


def test_levels_match_as_each_threshold_alone(spark):
    import random

    draw = random.Random(2)
    rows = [(1, f, g, h, draw.random()) for f in range(600) if f % 3 for g in range(3) for h in range(10, 13) if draw.random() < 0.6]
    pairs = spark.createDataFrame(rows, "camera_id long, frame_index long, gt_id long, hyp_id long, iou double")
    levels = [0.2, 0.5, 0.8]
    got = {(r.alpha, r.frame_index, r.gt_id, r.hyp_id) for r in D.match_levels(pairs, levels).collect()}
    alone = {(a, r.frame_index, r.gt_id, r.hyp_id) for a in levels for r in D.match_frames(pairs, a).collect()}
    assert got == alone and len(got) > 600


def test_rows_that_divide_by_nothing(spark):
    """An hour without samples, a foot on the horizon and two frames of one time give nulls, not errors."""
    minutes = "camera_id long, bucket_start timestamp, sample_count long, expected_samples long, occupancy_sum long, occupancy_max long, entries long, exits long"
    cameras = spark.sql("select 1L as camera_id, true as enabled, 'f' as field_id, cast(null as string) as market_id, cast(null as string) as booth_id")
    rows = spark.sql("select 1L as camera_id, timestamp '2024-01-01 10:00:00' as bucket_start, 0L as sample_count, 30L as expected_samples, 0L as occupancy_sum, 0L as occupancy_max, 0L as entries, 0L as exits")
    assert minutes.count(",") == len(rows.columns) - 1
    hour = facts.location_hours(rows, cameras).collect()
    assert len(hour) == 1 and hour[0].occupancy_sum is None and hour[0].contributing_sources == 0
    queues = spark.sql("select 0.0D as wait_sum_seconds, 0L as wait_sample_count, 0L as sla_met, 0L as throughput")
    total = io.bundle_summary(rows, queues).first()
    assert (total.average_occupancy, total.average_wait_minutes, total.sla_percent) == (None, None, None)
    from flowlake.functions import geometry as G

    horizon = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 1, -10)])
    ground = spark.range(1).select(G.box_ground(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(10.0), horizon).alias("g")).first().g
    assert ground.x is None and ground.xx is None
    pair = spark.sql("select 0D as ax, 0D as ay, 1D as bx, 0D as by, 0D as known")
    assert D.check_ground_distance(pair, F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])).first().relative_error is None
    obs = "camera_id long, track_id long, frame_index long, ts double, px double, py double, x1 double, y1 double, x2 double, y2 double, confirmed boolean, arrival long"
    seen = spark.createDataFrame([(1, 1, k, 0.0, 5.0, 5.0, 4.0, 0.0, 6.0, 5.0, True, k) for k in range(2)], obs)
    square = G.literal_polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
    queue = spark.sql("select 1L as camera_id, 'q' as queue_id, 1D as dwell, 5D as max_speed, 1D as gap, named_struct('x', 0.5D, 'y', 0.5D) as service, 0.1D as radius").withColumn("polygon", square)
    assert motion.queue_visits(seen, seen.select("camera_id", "frame_index", "ts"), queue, (100, 100)).count() == 1


def test_wait_event_ids_tell_waits_apart(spark):
    """The id hashes camera, queue, minute with offset, place and the wait itself."""
    import hashlib

    rows = spark.sql("select 'c' as camera_id, 'q' as queue_id, timestamp '2024-01-01 10:00:00' as bucket_start, array(12.5D, 300D) as completed_waits")
    got = {r.wait_seconds: r.event_id for r in facts.wait_events(rows).collect()}
    for k, wait in enumerate((12.5, 300.0)):
        assert got[wait] == hashlib.sha256(f"c:q:2024-01-01T10:00:00+00:00:{k}:{wait}".encode()).hexdigest()


def test_queue_minutes_cut_negative_values(spark):
    from flowlake.operators import minutes as M

    rows = spark.sql("select 1L as camera_id, 'q' as queue_id, timestamp '2024-01-01 10:00:00' as at, -3L as length, -5D as wait, 0.1D as speed_m, 0L as completed, cast(null as double) as last_wait")
    got = M.queue_minutes(rows.union(rows.withColumns({"length": F.lit(2).cast("long"), "wait": F.lit(None).cast("double")}))).first()
    assert (got.length_sum, got.wait_sum_seconds, got.wait_sample_count, got.length_max) == (2, 0.0, 1, 2)


def test_camera_files_configure_the_operators(spark, tmp_path):
    text = """
camera: {id: lobby}
analytics:
  occupancy_zones:
    - {id: all, points: [[0, 0], [1, 0], [1, 1], [0, 1]]}
  restricted_zones:
    - {id: safe, points: [[0, 0], [1, 0], [1, 1]], entry_dwell_seconds: 3, active_schedule: {start: '22:00', end: '06:30', weekdays: [0, Friday], timezone: Asia/Tehran}}
    - {id: open, points: [[0, 0], [1, 0], [1, 1]]}
  counting_lines:
    - {id: door, start: [0.1, 0.5], end: [0.9, 0.5], positive_label: in}
  queues:
    - {id: till, polygon: [[0, 0], [1, 0], [1, 1]], service_point: {point: [0.25, 0.75]}, overflow_threshold: 4}
"""
    (tmp_path / "a.yaml").write_text(text)
    configs = io.read_camera_configs(spark, str(tmp_path / "*.yaml"))
    one = lambda kind: {r[1]: r for r in io.layout(configs, kind, (101, 51)).collect()}
    assert [(p.x, p.y) for p in one("occupancy")["all"].polygon] == [(0, 0), (100, 0), (100, 50), (0, 50)]
    safe, always = one("restricted")["safe"], one("restricted")["open"]
    assert (safe.dwell, safe.grace, safe.cooldown, safe.days, safe.from_minute, safe.to_minute, safe.timezone) == (3.0, 1.0, 30.0, [0, 4], 1320, 390, "Asia/Tehran")
    assert always.days is None and always.dwell == 1.0
    door = one("line")["door"]
    assert (door.start.x, door.end.x, door.hysteresis, door.positive, door.negative) == (0.1, 0.9, 0.01, "in", "exit")
    till = one("queue")["till"]
    assert (till.service.x, till.service.y, till.overflow, till.alpha, till.dwell, till.max_speed) == (0.25, 0.75, 4, 0.35, 2.0, 40.0)


def test_business_days_start_at_local_midnight():
    q = reports.Query.of_days("2026-08-11", "2026-08-12", comparison="previous_week")
    assert (q.start, q.end, q.comparison) == ("2026-08-10 20:30:00", "2026-08-12 20:30:00", "previous_week")
    assert reports.Query.of_days("2024-03-31", "2024-03-31", zone="Europe/Berlin").end == "2024-03-31 22:00:00"


def test_points_as_text_have_all_digits(spark):
    """Thousandths beyond 17 digits are the double's own, as in SQL."""
    values = [0.0, 0.5, -3.25, 12.3456, 600000000000.0 * 25, 899999999999917.0, 899999999999913.0, 8.1e15 + 1, 3.6e17 + 64, -7.7e18, 1.2345e30]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    point = F.array(F.struct(F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("value"), F.lit(0.5).alias("intensity")))
    got = {r.v: r.t for r in rows.select("v", scalars.flat(point).alias("t")).collect()}
    assert got == {v: f"{int(round(v * 1000))}/0/500" for v in values}


def test_suppression_over_batches(spark):
    """Frames of all sizes in small batches, one frame over several of them, against the rule box by box; a few calls, not one a frame."""
    draw = np.random.default_rng(4)
    sizes = [1, 2, 7, 40, 1, 3, 90, 5]
    frames = np.repeat(np.arange(len(sizes)), sizes)
    x, y = draw.integers(0, 30, len(frames)).astype(float), draw.integers(0, 30, len(frames)).astype(float)
    boxes = pd.DataFrame({"camera_id": [None if f == 3 else int(f) // 3 for f in frames], "frame_index": frames, "box_id": draw.permutation(len(frames)), "x1": x, "y1": y, "x2": x + 8, "y2": y + 12, "score": draw.integers(0, 5, len(frames)) / 5.0})
    want = []
    for _, part in boxes.groupby("frame_index"):
        kept = []
        for b in part.sort_values(["score", "box_id"], ascending=[False, True]).itertuples():
            if all(D.overlaps(np.array([[b.x1, b.y1, b.x2, b.y2]]), np.array(k))[0] <= 0.3 for k in kept):
                kept.append((b.x1, b.y1, b.x2, b.y2))
                want.append(b.box_id)
    rows = spark.createDataFrame([(None if r[0] != r[0] else int(r[0]), *r[1:]) for r in boxes.astype(object).itertuples(index=False, name=None)], "camera_id long, frame_index long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = D.suppress_overlaps(rows, 0.3)
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.box_id for r in found.collect()) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_matching_by_plain_numbers_and_without_groups(spark, monkeypatch):
    """Small tables of costs, ties included, give the pairs that arrays give; frames are read sorted, not one group a call."""
    draw = np.random.default_rng(8)
    tables = [draw.integers(0, 4, (n, m)) / 4 + 1e5 * (draw.random((n, m)) < 0.4) for n, m in [(1, 1), (2, 2), (3, 5), (5, 5), (7, 9)] * 20]
    small = [D.assign_small(t.tolist(), *t.shape) for t in tables]
    monkeypatch.setattr(D, "SMALL", 0)
    assert small == [D.assign(t) for t in tables]
    pairs = spark.createDataFrame([(1, 1, 1, 1, 0.9), (1, 1, 1, 2, 0.8), (1, 1, 2, 1, 0.85), (1, 2, 1, 1, 0.3)], "camera_id long, frame_index long, gt_id long, hyp_id long, iou double")
    found = D.match_levels(pairs, [0.05, 0.5])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.alpha, r.frame_index, r.gt_id, r.hyp_id) for r in found.collect()) == [(0.05, 1, 1, 2), (0.05, 1, 2, 1), (0.05, 2, 1, 1), (0.5, 1, 1, 2), (0.5, 1, 2, 1)]


def test_trackers_are_compared_on_settled_boxes(spark):
    """The measures go on from boxes and matches that were made once, not made anew for each."""
    rows = [(1, f, t, 10.0 * t, 10.0, 10.0 * t + 8, 30.0) for f in range(5) for t in (1, 2, 3)]
    made = spark.createDataFrame(rows, "camera_id long, frame_index long, track_id long, x1 double, y1 double, x2 double, y2 double")
    made = made.mapInPandas(lambda batches: batches, made.schema)
    got = D.compare_trackers(made, {"a": made, "b": made.where("frame_index > 1")})
    assert "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.tracker, r.tp, r.fn, r.hota < 1) for r in got.collect()) == [("a", 15, 0, False), ("b", 9, 6, True)]


def test_queue_hours_count_cameras_without_distinct(spark):
    """Minutes of a camera and hour become one row before they go to each location's group."""
    sums = ", ".join(f"{c} long" for c in facts.QUEUE_SUMS)
    row = lambda camera, minute, ok: (camera, "q", pd.Timestamp(f"2024-01-01 08:{minute:02d}:00").to_pydatetime(), *[1] * len(facts.QUEUE_SUMS), minute, ok)
    minutes = spark.createDataFrame([row(1, 1, True), row(1, 2, False), row(2, 3, False), row(3, 4, True), row(3, 59, None)], f"camera_id long, queue_id string, bucket_start timestamp, {sums}, length_max long, physically_calibrated boolean")
    cameras = spark.createDataFrame([(1, "f", "m", None), (2, "f", "m", "b"), (3, "f", "n", "c")], "camera_id long, field_id string, market_id string, booth_id string")
    rows = facts.queue_location_hours(minutes, cameras)
    got = {(r.location_type, r.location_id): (r.sample_count, r.length_max, r.calibrated_sources) for r in rows.collect()}
    assert got == {("field", "f"): (5, 59, 2), ("market", "m"): (3, 3, 1), ("booth", "b"): (1, 3, 0), ("market", "n"): (2, 59, 1), ("booth", "c"): (2, 59, 1)}
    assert "distinct" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_periods_are_cut_before_last_writes_are_sought(spark):
    """A filter by time reaches below the window."""
    for rows in (management.minutes(spark, "/root/testdata/sf0.001"), management.queue_minutes(spark, "/root/testdata/sf0.001")):
        plan = rows.where("bucket_start < timestamp '2024-01-02 00:00:00'")._jdf.queryExecution().optimizedPlan().toString()
        assert "2024-01-02" in plan[plan.index("Window"):]


def test_minutes_are_parsed_and_judged_in_one_pass(spark):
    plan = scalars.QUERIES["validate_minutes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("Generate explode") == 1
