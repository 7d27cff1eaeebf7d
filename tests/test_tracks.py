"""Scenarios of the track operators, and the native forms against plain step functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators import heat, intrusion, motion, people, steps
from flowlake.plans import fixtures as X

SCHEMA = "camera_id long, track_id long, frame_index long, ts double, px double, py double, x1 double, y1 double, x2 double, y2 double, confirmed boolean, arrival long"
SIZE = (101, 101)


def configured(spark, polygon, **settings):
    """One region of camera 1 with its settings."""
    values = {k: v if hasattr(v, "cast") else F.lit(v) for k, v in settings.items()}
    return spark.range(1).select(F.lit(1).cast("long").alias("camera_id"), polygon.alias("polygon")).withColumns(values)


def area(spark, dwell, grace, cooldown, **schedule):
    return configured(spark, X.square(), zone_id="secure", dwell=dwell, grace=grace, cooldown=cooldown, **schedule)


def frame(spark, rows):
    """(ts, track, x, y); a track of None is a frame without people."""
    out = [(1, t, int(10 * ts), float(ts), float(x), float(y), x - 3.0, y - 12.0, x + 3.0, float(y), True, n) for n, (ts, t, x, y) in enumerate(rows) if t is not None]
    obs = spark.createDataFrame(out, SCHEMA)
    clock = spark.createDataFrame(sorted({(1, int(10 * r[0]), float(r[0])) for r in rows}), "camera_id long, frame_index long, ts double")
    return obs, clock


def crossings(spark, rows, hysteresis=0.03):
    obs, clock = frame(spark, rows)
    return [(r.frame_index / 10, r.direction) for r in people.line_crossings(obs, clock, X.lines(obs).where("line_id = 'door'").withColumn("hysteresis", F.lit(hysteresis)), SIZE).orderBy("frame_index").collect()]


def test_line_crossing_both_ways(spark):
    assert crossings(spark, [(1, 1, 50, 40), (2, 1, 50, 60), (3, 1, 50, 40)]) == [(2.0, "entry"), (3.0, "exit")]


def test_line_crossing_ignores_jitter(spark):
    ys = [40, 48, 52, 49, 51, 60, 52, 48, 50, 51]
    assert [d for _, d in crossings(spark, [(k, 1, 50, y) for k, y in enumerate(ys)], 0.05)] == ["entry"]


def test_line_crossing_forgets_a_missing_track(spark):
    assert crossings(spark, [(1, 1, 50, 40), (2, None, 0, 0), (3, 1, 50, 60)]) == []


def restricted(spark, rows, dwell, grace, cooldown=10.0):
    obs, clock = frame(spark, rows)
    got = intrusion.restricted_events(obs, clock, area(spark, dwell, grace, cooldown)).orderBy("ts", "event_type").collect()
    return [(r.ts, r.event_type.removeprefix("restricted_area_"), r.seconds, r.confirmed) for r in got]


IN, OUT = (50, 50), (95, 95)


def test_restricted_short_visit(spark):
    got = restricted(spark, [(0, 1, *IN), (0.2, 1, *OUT), (0.7, 1, *OUT)], 2.0, 0.5)
    assert [x[:2] for x in got] == [(0.0, "entered"), (0.7, "exited")]
    assert got[1][2] == pytest.approx(0.7) and got[1][3] is False


def test_restricted_missing_is_outside(spark):
    got = restricted(spark, [(0, 1, *IN), (1, 1, *OUT), (1.9, None, 0, 0), (2, None, 0, 0)], 0.0, 1.0)
    assert [x[:2] for x in got] == [(0.0, "confirmed"), (0.0, "entered"), (2.0, "exited")]


def test_restricted_cooldown_delays_an_alert(spark):
    rows = [(0, 1, *IN), (1, 1, *IN), (2, 1, *OUT), (3, 1, *IN), (4, 1, *IN), (11, 1, *IN)]
    assert [x[0] for x in restricted(spark, rows, 1.0, 0.0) if x[1] == "confirmed"] == [1.0, 11.0]


def test_restricted_matches_step_function(spark):
    draw, rows, want = random.Random(3), [], []
    state, ts = {}, 0.0
    for _ in range(300):
        ts += draw.choice([0.5, 1.0, 2.5])
        inside = {t for t in (1, 2, 3) if draw.random() < 0.6}
        shown = {t: (IN if t in inside else OUT) for t in (1, 2, 3) if t in inside or draw.random() < 0.7}
        rows += [(ts, t, *p) for t, p in shown.items()] or [(ts, None, 0, 0)]
        want += [(ts, t, e) for t, e, _, _ in steps.restricted_step(state, ts, inside, 1.0, 1.5, 6.0)]
    obs, clock = frame(spark, rows)
    got = intrusion.restricted_events(obs, clock, area(spark, 1.0, 1.5, 6.0)).collect()
    assert sorted((r.ts, r.track_id, r.event_type) for r in got) == sorted(want)


def visits(spark, rows, dwell=1.0, gap=1.0):
    obs, clock = frame(spark, rows)
    return motion.queue_visits(obs, clock, configured(spark, X.square(), queue_id="q", dwell=dwell, max_speed=1e9, gap=gap, service=G.point(F.lit(0.8), F.lit(0.5)), radius=0.08), SIZE).orderBy("since")


def test_queue_leaves_region_at_the_service_point(spark):
    got = visits(spark, [(0, 1, 50, 50), (1, 1, 60, 50), (3, 1, 85, 50)], gap=5.0).collect()[0]
    assert (got.joined_at, got.left_at, got.reason, got.waiting, got.completed) == (1.0, 3.0, "outside_polygon", 3.0, True)


def test_queue_gap_is_strict(spark):
    got = visits(spark, [(0, 1, 50, 50), (0.5, None, 0, 0), (1, 1, 50, 50), (1.8, None, 0, 0), (2.1, None, 0, 0)]).collect()[0]
    assert (got.joined_at, got.left_at, got.reason) == (1.0, 2.1, "tracking_gap")


def test_queue_matches_step_function(spark):
    draw, rows, want = random.Random(9), [], []
    state, ts = {}, 0.0
    for _ in range(300):
        ts += draw.choice([0.5, 1.0, 2.0])
        shown = {t: draw.choice([IN, IN, OUT]) for t in (1, 2, 3) if draw.random() < 0.7}
        rows += [(ts, t, *p) for t, p in shown.items()] or [(ts, None, 0, 0)]
        want += [(ts, f[0], f[1]) for f in steps.queue_step(state, ts, [(t, *p, p == IN, True) for t, p in shown.items()], 1.0, 1.0)]
    got = visits(spark, rows).collect()
    got = [(r.joined_at, r.track_id, "queue_joined") for r in got if r.joined_at is not None] + [(r.left_at, r.track_id, "queue_left") for r in got if r.joined_at is not None and r.left_at is not None]
    assert sorted(got) == sorted(want)


def test_heatmap_dwell_goes_to_the_cell_before(spark):
    obs, _ = frame(spark, [(10, 1, 5, 5), (10.75, 1, 15, 5)])
    got = heat.dwell(obs, 4, 2, (0.0, 0.0, 40.0, 20.0), 5.0).collect()
    assert [(r.row, r.col, r.dwell_seconds) for r in got] == [(0, 0, 0.75)]
    assert heat.occupancy(obs, 4, 2, (0.0, 0.0, 40.0, 20.0)).agg(F.sum("occupancy")).first()[0] == 2


def test_heatmap_window_starts_at_data(spark):
    _, clock = frame(spark, [(0, None, 0, 0), (1.5, None, 0, 0), (2.0, None, 0, 0), (5.5, None, 0, 0)])
    got = heat.window_starts(clock, 2.0).orderBy("ts").collect()
    assert [r.window_start for r in got] == [0.0, 0.0, 2.0, 5.5]


def test_speed_rejects_a_jump():
    state = {}
    args = (None, None, 3.0, 1.0, 50.0, 12.0)
    assert steps.speed_step(state, 0.0, 0.0, 0.0, *args)["reason"] == "too little history"
    assert steps.speed_step(state, 1.0, 10.0, 0.0, *args)["px"] == 10.0
    assert steps.speed_step(state, 2.0, 100.0, 0.0, *args) == {"px": None, "m": None, "reason": "pixel jump", "vx": 10.0, "vy": 0.0}
    assert steps.speed_step(state, 3.0, 30.0, 0.0, *args)["px"] == 10.0


def test_vertical_rows_and_their_ids():
    people_ = [(20.0, 1), (23.0, 2), (50.0, 5), (70.0, 3), (75.0, 4)]
    assert [[p[1] for p in c] for c in steps.rows_of(people_, 8.08, 2)] == [[1, 2], [3, 4]]
    state = {}
    assert steps.row_step(state, [21.5, 72.5], 12.0) == [1, 2]
    assert steps.row_step(state, [23.0], 12.0) == [1]
    assert steps.row_step(state, [23.0, 72.5], 12.0) == [1, 3]


def test_geometry(spark):
    one = spark.range(1)
    square = G.literal_polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
    wedge = G.literal_polygon([(1, 1), (9, 1), (5, 5), (9, 9), (1, 9)])
    p = lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    row = one.select(
        G.point_in_polygon(F.lit(0.0), F.lit(5.0), square).alias("edge"), G.point_in_polygon(F.lit(0.0), F.lit(5.0), square, boundary=False).alias("open"), G.point_in_polygon(F.lit(8.0), F.lit(5.0), wedge).alias("notch"),
        G.polygon_area(wedge).alias("area"), G.bbox_coverage(F.lit(8.0), F.lit(8.0), F.lit(12.0), F.lit(12.0), square).alias("cover"), G.bbox_coverage(F.lit(5.0), F.lit(4.0), F.lit(9.0), F.lit(6.0), wedge).alias("concave"),
        G.segment_crossing(p(5, -1), p(5, 1), p(0, 0), p(10, 0)).alias("cross"), G.segment_crossing(p(5, -1), p(5, 0), p(0, 0), p(10, 0)).alias("touch"),
        G.project(F.lit(50.0), F.lit(100.0), F.array(*map(F.lit, [0.4, 0.0, 0.0, 0.0, 0.4, 0.0, 0.0, 0.0, 1.0]))).alias("ground"), G.project(F.lit(1.0), F.lit(1.0), F.lit(None).cast("array<double>")).alias("none"),
    ).first()
    assert (row.edge, row.open, row.notch) == (True, False, False)
    assert row.area == 48.0 and row.cover == 0.25 and row.concave == pytest.approx(1 / 8)
    assert row.cross.crossed and row.cross.direction == "negative_to_positive" and not row.touch.crossed
    assert math.isclose(row.ground.x, 20) and math.isclose(row.ground.y, 40) and row.none.reason == "not configured"


def test_cameras_keep_their_own_layout(spark):
    """Two cameras, two layouts, one pass: each camera meets its own zones, lines, areas and queues only."""
    obs, clock = frame(spark, [(0, 1, 50, 40), (1, 1, 50, 60), (2, 1, 50, 60), (9, 1, 5, 5)])
    two = lambda rows: rows.union(rows.withColumn("camera_id", F.lit(2).cast("long")))
    obs, clock = two(obs), two(clock)
    away = G.literal_polygon([(0, 0), (20, 0), (20, 20), (0, 20)])
    zones = configured(spark, X.square(), zone_id="a").union(configured(spark, away, zone_id="b").withColumn("camera_id", F.lit(2).cast("long")).select("camera_id", "polygon", "zone_id"))
    got = {(r.camera_id, r.zone_id, r.frame_index): r.people for r in people.zone_occupancy(obs, clock, zones).collect()}
    assert len(got) == 8 and got[1, "a", 10] == 1 and got[2, "b", 10] == 0 and got[2, "b", 90] == 1
    lines = X.lines(obs)  # the gate stands at camera 1 only
    assert {(r.camera_id, r.line_id) for r in people.line_totals(people.line_crossings(obs, clock, lines, SIZE), clock, lines).collect()} == {(1, "door"), (1, "gate"), (2, "door")}
    areas = zones.withColumns({"dwell": F.lit(0.0), "grace": F.lit(0.0), "cooldown": F.lit(0.0)})
    got = {(r.camera_id, r.zone_id, r.ts) for r in intrusion.restricted_events(obs, clock, areas).where("event_type = 'restricted_area_entered'").collect()}
    assert got == {(1, "a", 0.0)}  # in zone b the box is outside
    assert {(r.camera_id, r.zone_id) for r in intrusion.restricted_status(obs, clock, areas).collect()} == {(1, "a"), (2, "b")}


def test_restricted_schedule_ends_lives_without_events(spark):
    """On duty on Thursdays from minute 0 to 1 and, overnight, from 23:59: the epoch is a Thursday."""
    rows = [(0, 1, *IN), (30, 1, *IN), (60, 1, *IN), (90, None, 0, 0), (86340, 1, *IN), (86399, 1, *IN), (86400, 1, *IN), (86460, 1, *IN)]
    obs, clock = frame(spark, rows)
    day = dict(days=F.array(F.lit(3)), timezone="UTC")
    events = lambda **s: [(r.ts, r.event_type.removeprefix("restricted_area_")) for r in intrusion.restricted_events(obs, clock, area(spark, 0.0, 0.0, 10.0, **day, **s)).orderBy("ts", "event_type").collect()]
    assert events(from_minute=0, to_minute=1) == [(0.0, "confirmed"), (0.0, "entered")]
    assert events(from_minute=1439, to_minute=1) == [(86340.0, "confirmed"), (86340.0, "entered")]
    status = {r.frame_index: (r.active, r.current, r.entries, r.exits) for r in intrusion.restricted_status(obs, clock, area(spark, 0.0, 0.0, 10.0, from_minute=0, to_minute=1, **day)).collect()}
    assert status[300] == (True, 1, 1, 0) and status[600] == (False, 0, 1, 0) and status[863400] == (False, 0, 1, 0)


def test_next_frame_over_hours_without_frames(spark):
    """Asked times in hours without frames, at hour borders and after the last frame, against a plain search."""
    draw = random.Random(5)
    times = sorted({0.0, 3600.0, 7200.0} | {float(draw.randrange(40)) * 1800 + draw.choice([0.0, 0.5]) for _ in range(12)})
    asked = [draw.uniform(0, times[-1] + 9000) for _ in range(60)] + times
    frames = spark.createDataFrame([(1, t) for t in times], "camera_id long, ts double")
    rows = spark.createDataFrame([(1, t) for t in asked], "camera_id long, due double")
    got = {r.due: r.found for r in intrusion.next_frame_from(rows, frames, "due", "found").collect()}
    assert got == {t: min((x for x in times if x >= t - 1e-9), default=None) for t in asked}
    follow = {r.ts: r.after for r in intrusion.next_frames(frames).collect()}
    assert follow == dict(zip(times, [*times[1:], None]))


def test_prototypes_equal_a_plain_loop(spark):
    draw, want = random.Random(2), {}
    rows = [(draw.choice([1, 2, 3, None]), n, [draw.gauss(0, 1) for _ in range(4)]) for n in range(60)] + [(1, 60, [0.0] * 4)]
    for track, frame_, vector in rows:
        norm = math.sqrt(sum(x * x for x in vector))
        if track is None or norm == 0:
            continue
        unit = [x / norm for x in vector]
        old = want.get(track)
        mixed = unit if old is None else [0.8 * a + 0.2 * b for a, b in zip(old[0], unit)]
        length = math.sqrt(sum(x * x for x in mixed))
        want[track] = ([x / length for x in mixed], frame_)
    got = motion.gallery_prototypes(spark.createDataFrame(rows, "track_id long, frame long, vector array<double>").repartition(3)).collect()
    assert {r.track_id: r.last_seen for r in got} == {t: f for t, (_, f) in want.items()}
    assert all(r.vector == pytest.approx(want[r.track_id][0]) for r in got)


def test_queue_counts_are_those_of_the_status(spark):
    """Counts and overflow alone, against the full status, with joins and leavings in several blocks and frames at one time."""
    draw = random.Random(11)
    frames = spark.createDataFrame([(k, i, float(t)) for k in (1, 2) for i, t in enumerate(range(0, 9000, 300))], "camera_id long, frame_index long, ts double")
    stays = [(k, "q", t, 0.0, float(a), float(b) if b < 9000 else None, 1.0, False) for k in (1, 2) for t in range(9) for a in [draw.randrange(30) * 300] for b in [a + draw.randrange(1, 20) * 300]]
    stays.append((1, "q", 99, 0.0, None, None, None, False))
    visits = spark.createDataFrame(stays, "camera_id long, queue_id string, track_id long, since double, joined_at double, left_at double, waiting double, completed boolean")
    queues = spark.createDataFrame([(1, "q", 0.5, 3), (2, "q", 0.5, 2)], "camera_id long, queue_id string, alpha double, overflow int")
    columns = ["camera_id", "queue_id", "ts", "raw_count", "overflow"]
    got, want = (sorted(map(tuple, rows.select(*columns).collect())) for rows in (motion.queue_counts(visits, frames, queues), motion.queue_status(visits, frames, queues)))
    assert got == want and len(got) == 60 and {r[4] for r in got} == {True, False}
