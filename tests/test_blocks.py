"""Work in blocks against plain loops: totals, levels, next times, speeds, percentiles, matches, rows and the catalogue."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators import blocks, intrusion, motion, people, reports, steps
from flowlake.plans import fixtures as X
from flowlake.sources import io

SF = "/root/testdata/sf0.001"


def matrix():
    return F.array(*map(F.lit, X.HOMOGRAPHY))


def clocks(seed, odd=()):
    """(camera, time) rows with gaps of seconds, days and, for ``odd``, whatever it holds."""
    draw, rows = random.Random(seed), []
    for camera in (1, 2, 3):
        t = draw.random() * 1e4
        for _ in range(120):
            t += draw.choice([0.5, 1.0, 40.0, 4000.0, 500_000.0, 40_000_000.0])
            rows.append((camera, t))
    return rows + [(4, t) for t in odd]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_running_totals(spark):
    rows = [(c, t, k % 5 if k % 3 else None) for k, (c, t) in enumerate(clocks(1))]
    frame = spark.createDataFrame(rows, "camera long, ts double, v long")
    got = {(r.camera, r.ts): r.total for r in blocks.running_totals(frame, ["camera"], ["ts"], blocks.block_of(F.col("ts")), {"total": F.col("v")}).collect()}
    for camera in (1, 2, 3):
        total = 0
        for c, t, v in sorted(rows, key=lambda r: r[1]):
            if c == camera:
                total += v or 0
                assert got[c, t] == total


def test_last_known(spark):
    rows = [(c, t, k if k % 4 == 0 else None) for k, (c, t) in enumerate(clocks(2))]
    frame = spark.createDataFrame(rows, "camera long, ts double, v long")
    got = {(r.camera, r.ts): r.last for r in blocks.last_known(frame, ["camera"], ["ts"], blocks.block_of(F.col("ts")), "v", "last").collect()}
    last = {}
    for c, t, v in sorted(rows, key=lambda r: r[1]):
        last[c] = v if v is not None else last.get(c)
        assert got[c, t] == last[c]


def test_next_time_over_any_gap(spark):
    """Gaps of seconds to years, and one of 1.7e12 seconds, which a list of hours could not bridge."""
    clock = clocks(3, odd=(0.0, 1.0, 1.7e12))
    draw = random.Random(4)
    asked = [(c, t + draw.choice([0.0, 0.25, 3.0, 5000.0, 1e8, -20.0])) for c, t in clock] + [(9, 5.0), (1, None)]
    rows, times = spark.createDataFrame(asked, "camera long, due double"), spark.createDataFrame(clock, "camera long, ts double")
    got = sorted(map(tuple, blocks.next_time(rows, times, ["camera"], "due", "found").collect()), key=str)
    want = [(c, d, min((t for k, t in clock if k == c and t >= d - 1e-9), default=None) if d is not None else None) for c, d in asked]
    assert got == sorted(want, key=str)


def test_moving_levels(spark):
    rows = [(c, t, float(k % 7), 0.2 * c) for k, (c, t) in enumerate(clocks(5))]
    frame = spark.createDataFrame(rows, "camera long, ts double, v double, w double").repartition(7)
    level = lambda start: blocks.moving_levels(frame, ["camera"], ["ts"], blocks.block_of(F.col("ts"), 60.0), {"a": F.col("v"), "b": -F.col("v")}, F.col("w"), start)
    for start in (None, 0.0):
        got, now = {(r.camera, r.ts): (r.a, r.b, r.v) for r in level(start).collect()}, {}
        for c, t, v, w in sorted(rows, key=lambda r: r[1]):
            before = now.get(c, v if start is None else start)
            now[c] = w * v + (1 - w) * before
            assert got[c, t] == (pytest.approx(now[c], abs=1e-9), pytest.approx(-now[c], abs=1e-9), v)


def test_no_window_by_camera_alone(spark):
    """Rows of frames are ordered within blocks; only blocks of the highest level are ordered by camera."""
    obs = X.observations(spark, SF)
    frames, lines = X.frames(obs), X.lines(obs)
    crossings = people.line_crossings(obs, frames, lines, (X.WIDTH, X.HEIGHT)).limit(0)
    for found in (people.people_per_frame(obs, frames), people.line_totals(crossings, frames, lines), people.active_and_lost(obs, frames), intrusion.restricted_status(obs, frames, X.areas(obs))):
        windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
        assert windows and all("__block" in w or "__above" in w or "track_id" in w or "arrival" in w for w in windows)


def test_frames_with_a_time_in_milliseconds(spark):
    """A camera whose clock jumps by 1.7e12 seconds answers."""
    rows = [(1, 7, k, t, 50.0, 50.0) for k, t in enumerate((0.0, 1.0, 2.0))] + [(1, 8, 3, 1.7e12, 90.0, 90.0), (1, 8, 4, 1.7e12 + 2, 90.0, 90.0), (1, 7, 5, 1.7e12 + 5, 50.0, 50.0)]
    obs = spark.createDataFrame(rows, "camera_id long, track_id long, frame_index long, ts double, px double, py double")
    obs = obs.withColumns({"x1": F.col("px") - 3, "x2": F.col("px") + 3, "y1": F.col("py") - 12, "y2": F.col("py"), "confirmed": F.lit(True), "arrival": F.col("frame_index")})
    got = intrusion.restricted_events(obs, X.frames(obs), X.areas(obs).where("zone_id = 'secure'")).collect()
    assert sorted((r.ts, r.event_type.rsplit("_")[-1], r.track_id) for r in got) == [(0.0, "entered", 7), (1.0, "confirmed", 7), (1.7e12 + 2, "exited", 7), (1.7e12 + 5, "entered", 7)]
    visits = motion.queue_visits(obs, X.frames(obs), X.queues(obs).where("queue_id = 'secure'"), (X.WIDTH, X.HEIGHT)).collect()
    assert [(r.since, r.left_at, r.reason) for r in visits if r.since == 0.0] == [(0.0, 1.7e12, "tracking_gap")]


def speeds_by_loop(rows, h=0.1):
    out, state, last = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.camera_id, r.track_id, r.ts)):
        key = (r.camera_id, r.track_id)
        s = steps.speed_step(state.setdefault(key, {}), r.ts, r.px, r.py, r.px * h, r.py * h, 3.0, 2.0, 60.0, 12.0)
        out[(*key, r.frame_index)] = (s["px"], s["m"], s["reason"], steps.queue_speed(s, last.get(key), (r.ts, r.px, r.py)))
        last[key] = (r.ts, r.px, r.py)
    return out


def test_speeds_of_a_whole_table(spark):
    obs = X.observations(spark, SF)
    got = {(r.camera_id, r.track_id, r.frame_index): (r.speed_px, r.speed_m, r.reason, r.judged) for r in motion.speed(obs, matrix()).collect()}
    want = speeds_by_loop(people.dedupe_frame(obs).collect())
    assert got.keys() == want.keys() and len(got) > 500
    for k, found in want.items():
        assert got[k] == pytest.approx(found, nan_ok=True) if None not in found else [None if x is None else pytest.approx(x) for x in found] == list(got[k])


def test_queue_takes_the_speed_of_the_last_two_samples_without_another(spark):
    """Two samples further apart than the window: 30 pixels a second is too fast for a queue of 10."""
    rows = [(1, 7, 0, 0.0, 20.0, 50.0), (1, 7, 10, 1.0, 50.0, 50.0)]
    obs = spark.createDataFrame(rows, "camera_id long, track_id long, frame_index long, ts double, px double, py double")
    obs = obs.withColumns({"x1": F.col("px") - 3, "x2": F.col("px") + 3, "y1": F.col("py") - 12, "y2": F.col("py"), "confirmed": F.lit(True), "arrival": F.col("frame_index")})
    queues = X.queues(obs).where("queue_id = 'secure'").withColumns({"max_speed": F.lit(10.0), "dwell": F.lit(0.0)})
    visits = lambda window: motion.queue_visits(obs.where("frame_index = 10 or px < 21"), X.frames(obs), queues, (X.WIDTH, X.HEIGHT), motion.speed(obs, None, window=window)).collect()
    for window in (0.5, 3.0):
        assert [r for r in visits(window) if r.since == 1.0] == []
    slow = motion.speed(obs, None, window=0.5).collect()
    assert sorted((r.speed_px, r.judged) for r in slow if r.frame_index == 10) == [(None, 30.0)]


def test_percentiles(spark):
    draw = random.Random(8)
    for values in ([3.0], [5.0, 1.0], [float(draw.randrange(900)) for _ in range(501)], [draw.random() * 1e7 for _ in range(100)]):
        got = reports.wait_percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "wait_seconds double")).first()
        assert tuple(got) == pytest.approx(tuple(np.quantile(values, p) for p in (0.5, 0.9, 0.95)))
    assert tuple(reports.wait_percentiles(spark.createDataFrame([], "wait_seconds double")).first()) == (None, None, None)


def test_gallery_match_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(motion, "MATCHED", 16)
    monkeypatch.setattr(motion, "AGES", 4)
    draw = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    gallery = [(k, unit(draw.normal(size=6)).tolist(), int(draw.integers(0, 200))) for k in range(90)] + [(200, [1.0] + [0.0] * 5, 100), (201, [1.0] + [0.0] * 5, 100)]
    queries = [(k, int(draw.integers(0, 250)), draw.normal(size=6).tolist()) for k in range(70)] + [(300, 100, [2.0] + [0.0] * 5), (301, 900, [1.0] * 6), (302, 100, [0.0] * 6)]
    frames = spark.createDataFrame(queries, "query_id long, frame long, vector array<double>"), spark.createDataFrame(gallery, "track_id long, vector array<double>, last_seen long")
    found = motion.gallery_match(*frames, 0.3, 40)
    got = {r.query_id: (r.track_id, r.score) for r in found.collect()}
    for q, frame, v in queries:
        known = [(float(unit(np.array(v)) @ np.array(g)), t) for t, g, seen in gallery if frame - seen <= 40] if any(v) else []
        best = max(known, default=(0.0, None))
        want = (best[1], pytest.approx(best[0])) if best[0] >= 0.3 else (None, None)
        assert got[q] == want
    assert got[300][0] == 201 and got[301] == got[302] == (None, None)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    excluded = spark.createDataFrame([(201,)], "track_id long")
    assert {r.query_id: r.track_id for r in motion.gallery_match(*frames, 0.3, 40, excluded).collect()}[300] == 200
    assert motion.gallery_match(frames[0], frames[1].limit(0), 0.3, 40).where("track_id is not null").count() == 0


def test_rows_of_people_of_a_whole_table(spark):
    obs = X.observations(spark, SF)
    speeds = motion.speed(obs, matrix())
    known = {(r.camera_id, r.frame_index, r.track_id): (r.speed_px, r.speed_m) for r in speeds.collect()}
    frames, want = {}, {}
    for r in people.dedupe_frame(obs).collect():
        frames.setdefault((r.camera_id, r.frame_index), []).append(((r.x1 + r.x2) / 2, r.track_id, r.y1, r.y2))
    mean = lambda values: statistics.fmean(values) if values else None
    for key, here in frames.items():
        for c in steps.rows_of(here, 0.08 * X.WIDTH, 2):
            measures = [known[(*key, p[1])] for p in c]
            want[(*key, tuple(sorted(p[1] for p in c)))] = (statistics.fmean(p[0] for p in c), min(p[2] for p in c), max(p[3] for p in c), *(mean([m[k] for m in measures if m[k] is not None]) for k in (0, 1)))
    rows = motion.vertical_rows(obs, X.WIDTH, speeds=speeds).collect()
    got = {(r.camera_id, r.frame_index, tuple(r.track_ids)): (r.center, r.top, r.bottom, r.mean_px, r.mean_m) for r in rows}
    assert got.keys() == want.keys() and any(v[3] is not None for v in want.values())
    assert all([None if x is None else pytest.approx(x) for x in want[k]] == list(got[k]) for k in want)


def test_catalogue_from_a_database_and_from_files(spark, tmp_path):
    """An embedded database, read by ranges of a number with its filters pushed down, and the same tables as files."""
    url = f"jdbc:derby:{tmp_path}/catalogue;create=true"
    at = "timestamp '2024-01-0{} 00:00:00'"
    none = "cast(null as timestamp)"
    tables = {
        "camera": [f"select {k} as n, 'c{k}' as camera_id, {url_} as url, {at.format(k)} as created_at, {gone} as deleted_at" for k, url_, gone in ((1, "'rtsp://a'", none), (2, "'  '", none), (3, "'rtsp://c'", at.format(9)), (4, "'rtsp://d'", none), (5, "cast(null as string)", none))],
        "camera_region": [f"select {k} as n, '{c}' as camera_id, '{r}' as region_id, {gone} as deleted_at" for k, c, r, gone in ((1, "c1", "r1", none), (2, "c1", "r2", none), (3, "c4", "r1", at.format(9)))],
        "region": [f"select {k} as n, 'r{k}' as region_id, 'R{k}' as name, {gone} as deleted_at" for k, gone in ((1, none), (2, at.format(9)))],
    }
    for name, rows in tables.items():
        frame = spark.sql(" union all ".join(rows))
        frame.write.format("jdbc").options(url=url, dbtable=name).mode("append").save()
        frame.write.parquet(str(tmp_path / "files" / f"{name}.parquet"))
    for source, more in ((url, {"number": '"n"', "partitions": 3}), (url, {}), (str(tmp_path / "files"), {})):
        found = io.catalog_tables(spark, source, **more)
        cameras, live = io.read_camera_catalog(*found)
        assert [r.camera_id for r in cameras.collect()] == ["c4", "c1"]
        assert [(r.camera_id, r.region_id, r.name) for r in live.collect()] == [("c1", "r1", "R1")]
        plan = plan_of(cameras)
        assert "deleted_at" in plan.split("PushedFilters: [")[1].split("]")[0].lower()
        if more:
            assert found[0].rdd.getNumPartitions() == 3


def test_near_service_and_progress_in_metres(spark):
    rows = spark.createDataFrame([(1, 7, 0, 40.0, 50.0, 10.0, 0.0, 1.0, 0.0, 4.0, 5.0)], "camera_id long, track_id long, frame_index long, px double, py double, vx double, vy double, gvx double, gvy double, at_x double, at_y double")
    got = motion.queue_progress(rows, (80.0, 50.0), G.point(F.lit(4.0), F.lit(9.0))).first()
    assert (got.progress, got.progress_m) == (10.0, 0.0)
    assert motion.queue_progress(rows, (80.0, 50.0)).first().progress_m is None
