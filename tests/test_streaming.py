"""Streams against the same rules in batch."""

from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators import blocks, heat, intrusion, minutes, motion, people
from flowlake.plans import fixtures as X
from flowlake.plans import scalars
from flowlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def square(obs, **settings):
    """The floor of every camera as a region with its settings."""
    values = {k: v if hasattr(v, "cast") else F.lit(v) for k, v in settings.items()}
    return X.camera_ids(obs).withColumns({"polygon": X.square(), "dwell": F.lit(1.0)} | values)


def closing(columns):
    """A row of no camera far ahead, which lets all frames before it become complete."""
    return [F.lit({"camera_id": -1, "frame_index": 10**6, "ts": 1e6, "arrival": 10**12}.get(c)).cast(t).alias(c) for c, t in columns]


def prepared(spark, tmp_path):
    """Observations with their geometry, in files by time that share the frames at their borders; read back as a stream."""
    obs = X.observations(spark, SF)
    inside = people.zone_membership(obs, square(obs)).select("camera_id", "frame_index", "track_id", "inside")
    cell = G.grid_cell(F.col("px"), F.col("py"), 8, 6, (0.0, 0.0, 100.0, 100.0))
    rows = obs.join(inside, ["camera_id", "frame_index", "track_id"], "left").withColumns(
        {"inside": F.coalesce("inside", F.lit(False)), "slow": F.lit(True), "cell_row": cell["row"], "cell_col": cell["col"]}
    )
    columns = [c.split(" ")[0] for c in jobs.OBS.split(", ")]
    rows = rows.select(*columns).cache()
    file = F.least(F.floor((F.col("frame_index") + F.col("arrival") % 3 * 2) / 30), F.lit(3))
    for k in range(4):  # a frame may be cut over two files, and rows of it come up to 4 frames late
        rows.where(file == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
    spark.range(1).select(*closing(rows.dtypes)).write.mode("append").parquet(str(tmp_path / "obs"))
    return obs, jobs.stream_observations(spark, str(tmp_path / "obs"), files=1)


def run(stream, tmp_path, name, late=0):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = stream.sparkSession.table(name)
    assert (jobs.late_rows(rows, ["camera_id"]).agg(F.sum("late")).first()[0] or 0) == late
    return jobs.results(rows)


def test_restricted_stream_equals_batch(spark, tmp_path):
    obs, stream = prepared(spark, tmp_path)
    got = run(jobs.stream_restricted_events(stream, 1.0, 1.0, 10.0), tmp_path, "restricted").collect()
    want = intrusion.restricted_events(obs, X.frames(obs), square(obs, zone_id="secure", grace=1.0, cooldown=10.0)).collect()
    assert sorted((r.camera_id, r.ts, r.track_id, r.event_type) for r in got) == sorted((r.camera_id, r.ts, r.track_id, r.event_type) for r in want)


def test_crossing_and_heat_streams_equal_batch(spark, tmp_path):
    obs, stream = prepared(spark, tmp_path)
    band = 0.03 * 2**0.5 * 100
    side = lambda x, y: (y - 50 > band) - (y - 50 < -band)
    crossed = lambda x0, y0, x1, y1: 20 <= x0 + (50 - y0) / (y1 - y0) * (x1 - x0) <= 80
    got = run(jobs.stream_line_crossings(stream, side, crossed), tmp_path, "crossings").collect()
    want = people.line_crossings(obs, X.frames(obs), X.lines(obs).where("line_id = 'door'"), (X.WIDTH, X.HEIGHT)).collect()
    assert sorted((r.camera_id, int(r.ts), r.track_id, r.direction) for r in got) == sorted((r.camera_id, r.frame_index, r.track_id, r.direction) for r in want)
    cells = run(jobs.stream_heatmap(stream, None, 2.0, 30.0), tmp_path, "heat").groupBy("camera_id", "row", "col").agg(F.sum("samples").alias("n"), F.sum("seconds").alias("s"))
    flat = lambda rows, n, s: sorted((r.camera_id, r.row, r.col, r[n] or 0, r[s] or 0.0) for r in rows)
    batch = heat.occupancy(obs, 8, 6, (0.0, 0.0, 100.0, 100.0)).join(heat.dwell(obs, 8, 6, (0.0, 0.0, 100.0, 100.0), 2.0), ["camera_id", "row", "col"], "left")
    assert flat(cells.collect(), "n", "s") == flat(batch.collect(), "occupancy", "dwell_seconds")


def test_ingest_and_rollup_replay(spark, tmp_path):
    rows = X.minutes(spark, SF).where("minute_index < 2000").select("camera_id", "bucket_start", "sample_count", "expected_samples", "occupancy_sum", "occupancy_max", "entries", "exits", "arrival")
    rows.write.parquet(str(tmp_path / "in"))
    store, hours = str(tmp_path / "minutes"), str(tmp_path / "hours")
    for k in (1, 2):  # a second run from the start changes nothing
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(stream, store, str(tmp_path / f"c{k}")).awaitTermination(240)
        assert spark.read.parquet(store).count() == rows.select("camera_id", "bucket_start").distinct().count()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_rollups(stream, X.cameras(spark, SF), store, hours, str(tmp_path / "c3")).awaitTermination(240)
    total = spark.read.parquet(hours).where("location_type = 'field'").agg(F.sum("entries")).first()[0]
    assert total == spark.read.parquet(store).agg(F.sum("entries")).first()[0]


def test_queue_and_speed_streams_equal_batch(spark, tmp_path):
    obs, stream = prepared(spark, tmp_path)
    got = run(jobs.stream_queues(stream, 1.0, 1.0), tmp_path, "queues").collect()
    visits = motion.queue_visits(obs, X.frames(obs), square(obs, queue_id="q", max_speed=1e9, gap=1.0, service=G.point(F.lit(0.8), F.lit(0.5)), radius=0.08), (101, 101)).where("joined_at is not null").collect()
    want = [(r.camera_id, r.track_id, r.joined_at, "queue_joined") for r in visits] + [(r.camera_id, r.track_id, r.left_at, "queue_left") for r in visits if r.left_at is not None]
    assert sorted((r.camera_id, r.track_id, r.ts, r.event_type) for r in got) == sorted(want)
    speeds = run(jobs.stream_speed(stream), tmp_path, "speeds").collect()
    batch = motion.speed(obs, None).collect()
    flat = lambda rows: sorted((r.camera_id, r.track_id, r.ts, -1.0 if r.speed_px is None else r.speed_px) for r in rows)
    assert flat(speeds) == flat(batch)


def same(got, want, key, columns):
    """Both tables by key; numbers may differ by rounding to millionths."""
    table = lambda rows: sorted(([str(r[c]) for c in key], str(r["event_type"]) if "event_type" in columns else "", [r[c] for c in columns]) for r in rows.collect())
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6)
    left, right = table(got), table(want)
    return len(left) == len(right) and all(x[:2] == y[:2] and all(map(near, x[2], y[2])) for x, y in zip(left, right))


def test_streams_by_camera_equal_batch(spark, tmp_path):
    """Lines, areas with schedules and queues as rows of their cameras, over frames that files cut."""
    obs, stream = prepared(spark, tmp_path)
    clock, size = X.frames(obs), (X.WIDTH, X.HEIGHT)
    got = run(jobs.stream_crossings(stream, X.lines(obs), size), tmp_path, "by_line").withColumn("frame_index", F.col("ts").cast("long"))
    assert same(got, people.line_crossings(obs, clock, X.lines(obs), size), ["camera_id", "line_id", "frame_index", "track_id"], ["direction"])
    got = run(jobs.stream_restricted_areas(stream, X.areas(obs)), tmp_path, "by_area")
    want = intrusion.restricted_events(obs, clock, X.areas(obs))
    assert same(got, want, ["camera_id", "zone_id", "ts", "track_id"], ["event_type", "seconds", "confirmed"]) and want.count() > 50
    got = run(jobs.stream_queue_status(stream, X.queues(obs), size), tmp_path, "by_queue").cache()
    samples = blocks.settled(motion.queue_samples(obs, clock, X.queues(obs), motion.speed(obs, F.array(*map(F.lit, X.HOMOGRAPHY)))))
    visits = motion.visits_of(samples, size).cache()
    status = blocks.settled(motion.queue_status(visits, clock, X.queues(obs), motion.member_measures(samples, size)))
    columns = [c for c in jobs.STATUS if c != "last_wait"]  # of waits that end together, either is the last
    assert same(got.where("event_type is null"), status, ["camera_id", "queue_id", "ts"], columns)
    events = got.where("event_type like 'queue_joined' or event_type like 'queue_left'").select("camera_id", "queue_id", "track_id", "ts", "event_type")
    joined = visits.where("joined_at is not null")
    moves = joined.select("camera_id", "queue_id", "track_id", F.col("joined_at").alias("ts"), F.lit("queue_joined").alias("event_type"))
    moves = moves.union(joined.where("left_at is not null").select("camera_id", "queue_id", "track_id", F.col("left_at").alias("ts"), F.lit("queue_left").alias("event_type")))
    assert same(events, moves, ["camera_id", "queue_id", "track_id", "ts"], ["event_type"]) and moves.count() > 0
    assert same(got.where("event_type like 'queue_overflow%'"), motion.overflow_events(status), ["camera_id", "queue_id", "ts"], ["event_type"])


def feed(spark, tmp_path, *files):
    """A stream of (camera_id, ts, track_id, inside) rows, one file a micro-batch."""
    base = "camera_id long, ts double, track_id long, inside boolean"
    for k, rows in enumerate(files):
        frame = spark.createDataFrame([(int(c), None if t is None else float(t), i, x) for c, t, i, x in rows], base)
        extra = {"frame_index": F.lit(0).cast("long"), "confirmed": F.col("track_id").isNotNull(), "arrival": F.lit(k).cast("long"), "slow": F.lit(True)}
        extra |= {c: F.lit(50.0) for c in ("px", "py", "x1", "y1", "x2", "y2")} | {c: F.lit(0) for c in ("cell_row", "cell_col")}
        frame.withColumns(extra).select(*[c.split(" ")[0] for c in jobs.OBS.split(", ")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return jobs.stream_observations(spark, str(tmp_path / "feed"), files=1)


def test_late_rows_change_nothing_and_are_counted(spark, tmp_path):
    first = [(1, t, 7, True) for t in range(5)] + [(2, t, 8, t < 3) for t in range(5)]
    late = [(1, 2, 9, True), (1, 2, 7, False), (1, 3, 9, True), (2, 4, 8, True), (2, None, 8, True)]
    stream = feed(spark, tmp_path, first, [(1, 100, None, None)], [*late, (1, 101, None, None)], [(-1, 10**6, None, None)])
    out = jobs.stream_restricted_events(stream, 1.0, 1.0, 10.0)
    query = out.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = spark.table("late")
    counts = {(r.camera_id, r.ts): r.late for r in jobs.late_rows(rows, ["camera_id"]).collect()}
    assert counts == {(1, 2.0): 2, (1, 3.0): 1, (2, 4.0): 1, (2, None): 1}
    got = sorted((r.camera_id, r.ts, r.track_id, r.event_type.rsplit("_")[-1]) for r in jobs.results(rows).collect())
    assert got == [(1, 0.0, 7, "entered"), (1, 1.0, 7, "confirmed"), (1, 101.0, 7, "exited"), (2, 0.0, 8, "entered"), (2, 1.0, 8, "confirmed"), (2, 4.0, 8, "exited")]


def test_idle_state_is_freed(spark, tmp_path):
    """A camera that is silent for longer than ``idle`` leaves nothing in the state, and begins anew when it comes back."""
    stream = feed(spark, tmp_path, [(1, t, 7, True) for t in range(3)], [(2, 200, 8, True)], [(2, 300, 8, True)], [(1, 301, 7, True), (2, 301, 8, True)], [(2, 330, 8, True)])
    out = jobs.stream_restricted_events(stream, 1.0, 1.0, 10.0, idle=60.0)
    at = str(tmp_path / "idle")
    out.writeStream.format("memory").queryName("idle").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.camera_id, r.ts, r.event_type.rsplit("_")[-1]) for r in jobs.results(spark.table("idle")).collect() if r.camera_id == 1)
    assert got == [(1, 0.0, "entered"), (1, 1.0, "confirmed"), (1, 301.0, "entered")]
    held = lambda name, batch: {r.key.camera_id for r in spark.read.format("statestore").option("path", at).option("batchId", batch).option("stateVarName", name).load().collect()}
    assert held("rule", 1) == set() or held("rule", 1) == {1}
    assert 1 in held("rule", 2) | held("rule", 1) and 1 not in held("rule", 3) and 1 not in held("clock", 3)


def test_stream_minutes_equal_batch(spark, tmp_path):
    obs = X.observations(spark, SF)
    frames = people.people_per_frame(obs, X.frames(obs)).select("camera_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("frame_index") * 10).alias("at"), F.col("current_people").alias("people"))
    frames.write.parquet(str(tmp_path / "frames"))
    stream = jobs.stream_minutes(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames")))
    query = stream.writeStream.format("memory").queryName("minutes").option("checkpointLocation", str(tmp_path / "m")).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(240)
    want = minutes.camera_minutes(frames.withColumns({"entries": F.lit(0), "exits": F.lit(0)}))
    columns = ["camera_id", "bucket_start", "sample_count", "occupancy_sum", "occupancy_max", "occupancy_last"]
    assert sorted(map(tuple, spark.table("minutes").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def grown(spark, tmp_path, rows, name, stream_of, key):
    """What a stream of growing minutes has emitted last for each, its rows read twice over in two orders."""
    for k in range(3):  # a minute's rows come in several batches, so that it is emitted several times
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = stream_of(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    emitted = []
    keep = lambda batch, n: emitted.append([r.asDict() for r in batch.collect()])
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start().awaitTermination(240)
    last = {tuple(r[c] for c in key): r for batch in emitted for r in batch}
    assert sum(map(len, emitted)) > len(last)
    return last


def test_growing_minutes_end_as_in_batch(spark, tmp_path):
    """Camera-minutes, queue-minutes and the events of a minute, each emitted while it grows."""
    rows = scalars.frame_rows(spark, SF)
    last = grown(spark, tmp_path, rows, "camera", lambda s: jobs.stream_minutes(s, "10 years"), ["camera_id", "bucket_start"])
    want = {(r.camera_id, r.bucket_start): r.asDict() for r in minutes.camera_minutes(rows).collect()}
    assert last == want
    rows = scalars.queue_frames(spark, SF)
    last = grown(spark, tmp_path, rows, "queue", lambda s: jobs.stream_queue_minutes(s, "10 years"), ["camera_id", "queue_id", "bucket_start"])
    want = {(r.camera_id, r.queue_id, r.bucket_start): r.asDict() for r in minutes.queue_minutes(rows).collect()}
    assert last == want and any(r["completed_waits"] for r in want.values())
    rows = X.analytics_events(spark, SF)
    last = grown(spark, tmp_path, rows, "event", lambda s: jobs.stream_minute_events(s, "10 years", most=2), ["camera_id", "bucket_start"])
    got = {(*k, e.event_id, e.severity, e.metric_key) for k, r in last.items() for e in r["events"]}
    assert got == {(r.camera_id, r.bucket_start, r.event_id, r.severity, r.metric_key) for r in minutes.minute_events(rows, 2).collect()}


def test_ingest_of_more_than_a_thousand_days(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 86400).alias("bucket_start")
    rows = spark.range(1003).select(F.lit(1).cast("long").alias("camera_id"), at, F.col("id").alias("arrival"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_ingest(stream, str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "store")).select("bucket_start").distinct().count() == 1003


def test_documents_become_facts_and_replays_change_nothing(spark, tmp_path):
    import json

    def document(at, n, **more):
        doc = {"cameraId": "c", "bucketStart": f"2024-01-01T00:0{at}:00Z", "sampleCount": n, "expectedSamples": 30, "entries": n}
        queue = {"queueId": "q", "queueName": "Q", "sampleCount": n, "lengthSum": 1.0, "completedWaitSeconds": [10.0, 400.0]}
        event = {"eventId": f"e{at}", "eventType": "line_crossed", "title": f"t{n}", "severity": "info", "occurredAt": f"2024-01-01T00:0{at}:30Z"}
        spatial = {"zoneId": "z", "layer": "dwell", "points": [{"x": 1.0, "y": 2.0, "value": float(n), "intensity": 0.5}]}
        return json.dumps(doc | {"queues": [queue], "events": [event], "spatial": [spatial]} | more)

    written = [document(1, 5), document(1, 7, cameraName="Gate"), document(2, 9, physicallyCalibrated=True), document(3, -1)]
    schema = "line string, arrival long"
    for k, part in enumerate((written[:2], written[2:])):
        spark.createDataFrame([(x, 10 * k + n) for n, x in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for run_ in (1, 2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.stream_documents(stream, store, str(tmp_path / f"d{run_}")).awaitTermination(240)
        read = lambda name: spark.read.parquet(f"{store}/{name}")
        assert sorted((r.bucket_start.minute, r.sample_count) for r in read("minute").collect()) == [(1, 7), (2, 9)]
        assert sorted((r.queue_id, r.sample_count) for r in read("queue").collect()) == [("q", 7), ("q", 9)]
        assert sorted((r.wait_seconds, r.sla_met) for r in read("wait").collect()) == [(10.0, True), (10.0, True), (400.0, False), (400.0, False)]
        assert sorted((r.event_id, r.title) for r in read("event").collect()) == [("e1", "t5"), ("e2", "t9")]
        assert sorted((r.layer, r.points[0].value) for r in read("spatial").collect()) == [("dwell", 7.0), ("dwell", 9.0)]
        assert [(r.camera_id, r.calibrated) for r in read("source").collect()] == [("c", True)]
        assert [r.reasons for r in read("rejected").collect()] == [["sample_count", "negative", "queue"]]


def test_a_crash_between_merge_and_replacement_loses_nothing(spark, tmp_path):
    day = lambda rows: spark.createDataFrame(rows, "camera_id long, bucket_start timestamp, n long, arrival long").withColumn("day", F.to_date("bucket_start"))
    at, path, staged = __import__("datetime").datetime(2024, 1, 1), str(tmp_path / "p"), str(tmp_path / "s")
    merge = jobs.last_of("camera_id", "bucket_start")
    jobs.replace_days(day([(1, at, 5, 1), (2, at, 6, 1)]), merge, path, staged, 0)
    new = day([(1, at, 7, 2)])
    jobs.replace_days(new, merge, path, staged, 1)
    jobs.remove(spark, f"{path}/day=2024-01-01")  # the day was taken away, its new form not yet put in place
    jobs.replace_days(new, merge, path, staged, 1)
    assert sorted((r.camera_id, r.n) for r in spark.read.parquet(path).collect()) == [(1, 7), (2, 6)]
