"""Structured Streaming forms of the incremental operators.

A camera's frames are its clock, so rules that follow it keep their state by camera (and line, area
or queue), or by camera and track where the track alone decides. The step functions of
``flowlake.operators.steps`` serve streams and batch folds alike. A frame without people is a row
without a track.

Rows wait in the state until the watermark has passed their frame: only then is a frame complete,
however many micro-batches brought its rows, and it runs once, in order of time. Rows that come
after that are late: they change nothing and are counted, in the result's ``late`` column. State that
a rule has not touched for ``idle`` seconds of event time is freed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlake.functions import geometry as G
from flowlake.operators import facts, steps
from flowlake.operators.intrusion import on_duty
from flowlake.operators.people import COVERAGE
from flowlake.sources import io

OBS = "camera_id long, track_id long, frame_index long, ts double, px double, py double, x1 double, y1 double, x2 double, y2 double, confirmed boolean, arrival long, inside boolean, slow boolean, cell_row int, cell_col int"
DELAY = "10 seconds"
IDLE = 3600.0
FORGET = 600.0  # seconds after which a track that is not seen again has no last sample
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_observations(spark: SparkSession, path: str, schema: str = OBS, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def plain(value):
    """A value as JSON has it."""
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and math.isnan(value) else value


def opened(entries: dict[str, str]) -> dict:
    """A rule's state from its stored entries, one for each name, or for each track under a name."""
    state: dict = {}
    for name, value in entries.items():
        outer, inner = json.loads(name)
        if inner is None:
            state[outer] = json.loads(value)
        else:
            state.setdefault(outer, {})[inner] = json.loads(value)
    return state


def stored(state: dict) -> dict[str, str]:
    found = {}
    for outer, value in state.items():
        if isinstance(outer, str) and isinstance(value, dict):
            found |= {json.dumps([outer, plain(k)]): json.dumps(v, default=plain) for k, v in value.items()}
        else:
            found[json.dumps([plain(outer), None])] = json.dumps(value, default=plain)
    return found


class CompleteFrames(StatefulProcessor):
    """Holds rows until the watermark has passed their frame, then runs ``step`` on each frame of the key."""

    def __init__(self, key: list[str], rows: T.StructType, step: Callable, columns: list[str], idle: float):
        self.key, self.fields, self.step, self.columns, self.idle = key, rows, step, columns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.rule = handle.getMapState("rule", "name string", "value string")
        self.clock = handle.getValueState("clock", "ts double")

    def table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.key, "ts", *self.columns, "late"])

    def wake(self, ts: float) -> None:
        self.handle.registerTimer(math.ceil(ts * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, mark = [f.name for f in self.fields], timerValues.getCurrentWatermarkInMs() / 1000
        late: dict[float, int] = {}
        fresh: list[tuple] = []
        for pdf in rows:
            for row in pdf[names].itertuples(index=False, name=None):
                row = tuple(None if x is pd.NaT else plain(x) for x in row)
                ts = row[names.index("ts")]
                if ts is None or 0 < mark >= ts:  # a watermark of 0 is none yet
                    late[ts] = late.get(ts, 0) + 1
                else:
                    fresh.append(row)
        if fresh:
            if not self.waiting.exists():
                self.wake(min(r[names.index("ts")] for r in fresh))
            else:
                self.wake(min(r[names.index("ts")] for r in [*fresh, *self.waiting.get()]))
            self.waiting.appendList(fresh)
        yield self.table(key, [(ts, *[None] * len(self.columns), n) for ts, n in sorted(late.items(), key=str)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names, mark = [f.name for f in self.fields], timerValues.getCurrentWatermarkInMs() / 1000
        at = names.index("ts")
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[at] <= mark], [r for r in rows if r[at] > mark]
        clock = self.clock.get()[0] if self.clock.exists() else None
        out: list[tuple] = []
        if due:
            entries = {k[0]: v[0] for k, v in self.rule.iterator()} if self.rule.exists() else {}
            if clock is not None and min(r[at] for r in due) - clock > self.idle:
                self.rule.clear()
                entries = {}
            state = opened(entries)
            frame = pd.DataFrame(due, columns=names).sort_values(["ts", "arrival"], kind="stable")
            for ts, part in frame.groupby("ts", sort=True):
                if clock is not None and ts - clock > self.idle:
                    state = {}
                clock = ts
                out += [(ts, *found, None) for found in self.step(state, ts, part)]
            now = stored(state)
            for name in entries.keys() - now.keys():
                self.rule.removeKey((name,))
            for name, value in now.items():
                if entries.get(name) != value:
                    self.rule.updateValue((name,), (value,))
            self.clock.update((clock,))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self.wake(min(r[at] for r in rest))
        elif clock is not None:
            if mark - clock >= self.idle:
                self.rule.clear()
                self.clock.clear()
            elif due:
                self.wake(clock + self.idle)
        yield self.table(key, out)

    def close(self) -> None:
        pass


def clocked(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """The rows with the watermark of their times; set before a join that drops cameras, as these move the clock too."""
    return stream.withColumn("__at", F.timestamp_millis(F.floor(F.col("ts") * 1000).cast("long"))).withWatermark("__at", delay)


def by_frame(stream: DataFrame, key: list[str], step: Callable[[dict, float, pd.DataFrame], list[tuple]], columns: list[str], schema: str, delay: str = DELAY, idle: float = IDLE) -> DataFrame:
    """Apply a step to each complete frame of each key, in order of time.

    A result has the key, ts, the step's ``columns`` and ``late``: null, or in rows of their own how many
    rows came too late for the frame at ts (which is null for rows without a time).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = (stream if "__at" in stream.columns else clocked(stream, delay)).drop("__at")  # the processor itself sees to late rows, to count them
    fields = T.StructType([f for f in rows.schema if f.name not in key])
    return rows.groupBy(*key).transformWithStateInPandas(CompleteFrames(key, fields, step, columns, idle), f"{schema}, late long", "Append", "EventTime")


def results(found: DataFrame) -> DataFrame:
    """The rows of the rule, without the counts of late ones."""
    return found.where("late is null").drop("late")


def late_rows(found: DataFrame, key: list[str]) -> DataFrame:
    """The counts of late rows by key and frame time."""
    return found.where("late is not null").select(*key, "ts", "late")


def people_of(frame: pd.DataFrame) -> pd.DataFrame:
    """The confirmed people of a frame, the last write of each."""
    return frame[frame["confirmed"].fillna(False).astype(bool)].drop_duplicates("track_id", keep="last")


def tracks_of(people: pd.DataFrame, *columns: str) -> list[tuple]:
    return [(int(t), *map(plain, more)) for t, *more in zip(people["track_id"], *(people[c] for c in columns))]


def within(stream: DataFrame, regions: DataFrame, delay: str) -> DataFrame:
    """Each row with each region of its camera and ``inside``, as ``people.zone_membership`` has it."""
    rows = clocked(stream.drop("inside", "slow"), delay).join(regions.withColumn("edges", G.edges(F.col("polygon"))), "camera_id")
    foot = G.in_edges(G.point(F.col("px"), F.col("py")), F.col("edges"))
    cover = G.bbox_coverage(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("polygon"))
    inside = F.coalesce(F.when(foot, cover >= COVERAGE - G.EPS), F.lit(False))
    return rows.withColumn("inside", inside).drop("edges", "polygon")


def stream_line_crossings(stream: DataFrame, side_of: Callable, crossed: Callable, **held) -> DataFrame:
    """One line for all cameras, given as functions of points."""

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        return steps.crossing_step(state, tracks_of(people_of(frame), "px", "py"), side_of, crossed)

    return by_frame(stream, ["camera_id"], step, ["track_id", "direction"], "camera_id long, ts double, track_id long, direction string", **held)


def stream_crossings(stream: DataFrame, lines: DataFrame, size: tuple[int, int], **held) -> DataFrame:
    """The lines of each camera, as ``people.line_crossings`` takes them: camera_id, line_id, ts, track_id, direction."""
    w, h = (float(n - 1) for n in size)
    ends = {f"{c}{k}": F.col(f"{p}.{k}") * n for c, p in (("a", "start"), ("b", "end")) for k, n in (("x", w), ("y", h))}
    known = lines.select("camera_id", "line_id", *[v.alias(k) for k, v in ends.items()], (F.col("hysteresis") * math.hypot(w, h)).alias("band"), "positive", "negative")

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        first = frame.iloc[0]
        ax, ay, bx, by, band = (float(first[k]) for k in ("ax", "ay", "bx", "by", "band"))
        far = math.hypot(bx - ax, by - ay)

        def side(x: float, y: float) -> int:
            off = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / far
            return (off > band) - (off < -band)

        crossed = lambda x0, y0, x1, y1: steps.meets(x0, y0, x1, y1, ax, ay, bx, by)
        return steps.crossing_step(state, tracks_of(people_of(frame), "px", "py"), side, crossed, (first["positive"], first["negative"]))

    rows = clocked(stream, held.get("delay", DELAY)).join(known, "camera_id")
    return by_frame(rows, ["camera_id", "line_id"], step, ["track_id", "direction"], "camera_id long, line_id string, ts double, track_id long, direction string", **held)


RESTRICTED = ["track_id", "event_type", "seconds", "confirmed"]


def stream_restricted_events(stream: DataFrame, dwell: float, grace: float, cooldown: float, **held) -> DataFrame:
    """``stream`` has ``inside`` for each row, found by the geometry columns; one rule for all cameras."""

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        p = people_of(frame)
        return steps.restricted_step(state, ts, {t for (t,) in tracks_of(p[p["inside"].astype(bool)])}, dwell, grace, cooldown)

    return by_frame(stream, ["camera_id"], step, RESTRICTED, "camera_id long, ts double, track_id long, event_type string, seconds double, confirmed boolean", **held)


def stream_restricted_areas(stream: DataFrame, areas: DataFrame, **held) -> DataFrame:
    """The areas of each camera with their own rules and schedules, as ``intrusion.restricted_events`` takes them."""
    timed = "days" in areas.columns
    rows = within(stream, areas, held.get("delay", DELAY)).withColumn("on", on_duty() if timed else F.lit(True))
    rows = rows.drop("days", "from_minute", "to_minute", "timezone")

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        first, p = frame.iloc[0], people_of(frame)
        if not first["on"]:
            state.pop("lives", None)
            return []
        return steps.restricted_step(state, ts, {t for (t,) in tracks_of(p[p["inside"].astype(bool)])}, float(first["dwell"]), float(first["grace"]), float(first["cooldown"]))

    return by_frame(rows, ["camera_id", "zone_id"], step, RESTRICTED, "camera_id long, zone_id string, ts double, track_id long, event_type string, seconds double, confirmed boolean", **held)


def stream_queues(stream: DataFrame, dwell: float, gap: float, **held) -> DataFrame:
    """``stream`` has ``inside`` and ``slow`` for each row; one rule for all cameras, joins and leaves only."""

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        people = [(t, x, y, bool(a), bool(b)) for t, x, y, a, b in tracks_of(people_of(frame), "px", "py", "inside", "slow")]
        return steps.queue_step(state, ts, people, dwell, gap)

    return by_frame(
        stream, ["camera_id"], step, ["track_id", "event_type", "seconds", "x", "y", "reason"], "camera_id long, ts double, track_id long, event_type string, seconds double, x double, y double, reason string", **held
    )


STATUS = ["raw_count", "smoothed_count", "present", "overflow", "mean_wait", "completed", "mean_completed", "last_wait", "speed_px", "speed_m", "progress_px", "progress_m"]
STATUS_TYPES = ["long", "double", "boolean", "boolean", "double", "long", "double", "double", "double", "double", "double", "double"]


def stream_queue_status(stream: DataFrame, queues: DataFrame, size: tuple[int, int], window: float = 3.0, least: float = 2.0, most_px: float = 60.0, most_m: float = 12.0, **held) -> DataFrame:
    """Events and the status of each camera's queues, as ``motion.queue_visits`` and ``queue_status`` take them.

    ``queues`` may have homography. Rows with event_type tell joins, leaves and overflow flips (of these
    ``seconds`` is the count); each frame has one row without, with the status.
    """
    queues = queues if "homography" in queues.columns else queues.withColumn("homography", F.lit(None).cast("array<double>"))
    ground = lambda x, y: G.project(x, y, F.col("homography"))
    w, h = (float(max(n - 1, 1)) for n in size)
    rows = within(stream, queues, held.get("delay", DELAY)).withColumns({"sx": F.col("service.x") * w, "sy": F.col("service.y") * h})
    rows = rows.withColumns({"g": ground(F.col("px"), F.col("py")), "sg": ground(F.col("sx"), F.col("sy"))})
    rows = rows.withColumns({"gx": F.col("g.x"), "gy": F.col("g.y"), "sgx": F.col("sg.x"), "sgy": F.col("sg.y")}).drop("g", "sg", "service", "homography")

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        first, speeds, people = frame.iloc[0], state.setdefault("speeds", {}), []
        for t, x, y, gx, gy, inside in tracks_of(people_of(frame), "px", "py", "gx", "gy", "inside"):
            own = speeds.setdefault(t, {})
            before = own.get("at")
            found = steps.speed_step(own, ts, x, y, gx, gy, window, least, most_px, most_m)
            own["at"] = (ts, x, y)
            speed = steps.queue_speed(found, before, (ts, x, y))
            toward = steps.progress(found["vx"], found["vy"], x, y, plain(first["sx"]), plain(first["sy"]))
            metres = steps.progress(*steps.ground_velocity(own, found), *steps.place_on_ground(own), plain(first["sgx"]), plain(first["sgy"]))
            people.append((t, x, y, bool(inside), speed is None or speed <= float(first["max_speed"]) + G.EPS, speed, found["m"], toward, metres))
        for gone in [t for t, own in speeds.items() if ts - own["at"][0] > max(FORGET, float(first["gap"]))]:
            del speeds[gone]
        near = lambda x, y: math.hypot(x / w - first["sx"] / w, y / h - first["sy"] / h) <= first["radius"] + G.EPS
        rule = {"dwell": float(first["dwell"]), "gap": float(first["gap"]), "alpha": float(first["alpha"]), "overflow": int(first["overflow"]), "done": near}
        events, status = steps.queue_status_step(state, ts, people, rule)
        return [(*e, *[None] * len(STATUS)) for e in events] + [(*[None] * 6, *[status[c] for c in STATUS])]

    columns = ["track_id", "event_type", "seconds", "x", "y", "reason"]
    types = "track_id long, event_type string, seconds double, x double, y double, reason string, " + ", ".join(f"{c} {t}" for c, t in zip(STATUS, STATUS_TYPES))
    return by_frame(rows, ["camera_id", "queue_id"], step, [*columns, *STATUS], f"camera_id long, queue_id string, ts double, {types}", **held)


def stream_heatmap(stream: DataFrame, window: float | None, max_gap: float, idle: float, **held) -> DataFrame:
    """Increments of cells: camera_id, ts, window_start, row, col, samples, seconds; sums give the map."""

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        p = frame[frame["track_id"].notna()].drop_duplicates("track_id", keep="last")
        people = [(t, None if r is None else (int(r), int(c)), bool(ok)) for t, r, c, ok in tracks_of(p, "cell_row", "cell_col", "confirmed")]
        return steps.heat_step(state, ts, people, window, max_gap, idle)

    return by_frame(
        stream, ["camera_id"], step, ["window_start", "row", "col", "samples", "seconds"], "camera_id long, ts double, window_start double, row int, col int, samples long, seconds double", **held
    )


def stream_speed(stream: DataFrame, window: float = 3.0, least: float = 2.0, most_px: float = 60.0, homographies: DataFrame | None = None, most_m: float = 12.0, **held) -> DataFrame:
    """Speeds of confirmed tracks, in metres too where ``homographies`` (camera_id, homography) has the camera."""
    rows = stream  # unconfirmed rows move the clock
    if homographies is None:
        rows = rows.withColumns({"gx": F.lit(None).cast("double"), "gy": F.lit(None).cast("double")})
    else:
        ground = G.project(F.col("px"), F.col("py"), F.col("homography"))
        rows = rows.join(homographies.select("camera_id", "homography"), "camera_id", "left").withColumns({"gx": ground["x"], "gy": ground["y"]}).drop("homography")

    def step(state: dict, ts: float, frame: pd.DataFrame) -> list[tuple]:
        seen = frame[frame["confirmed"].fillna(False).astype(bool)]
        if seen.empty:
            return []
        r = seen.iloc[-1]
        s = steps.speed_step(state, ts, float(r["px"]), float(r["py"]), plain(r["gx"]), plain(r["gy"]), window, least, most_px, most_m)
        return [(s["px"], s["m"], s["reason"])]

    return by_frame(rows, ["camera_id", "track_id"], step, ["speed_px", "speed_m", "reason"], "camera_id long, track_id long, ts double, speed_px double, speed_m double, reason string", **held)


def stream_minutes(frames: DataFrame, late: str = "10 minutes", expected: int = 30) -> DataFrame:
    """Camera-minutes that grow while their minute lasts (update mode), from camera_id, at, people and, where counted, entries and exits.

    Counters count their growth within the minute, as ``minutes.camera_minutes`` has it; what is emitted
    last for a minute is that operator's row.
    """
    rows = frames.where("people is not null").withColumn("people", F.greatest("people", F.lit(0)))
    rows = rows.withWatermark("at", late).groupBy("camera_id", F.window("at", "1 minute").alias("w"))
    grown = lambda c: F.greatest(F.max_by(c, "at") - F.min_by(c, "at"), F.lit(0)).alias(c)
    counters = [c for c in ("entries", "exits") if c in frames.columns]
    rows = rows.agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("people").alias("occupancy_sum"), F.max("people").alias("occupancy_max"), F.max_by("people", "at").alias("occupancy_last"), *map(grown, counters),
    )
    return rows.select("camera_id", F.col("w.start").alias("bucket_start"), "sample_count", F.lit(expected).alias("expected_samples"), F.col("sample_count").alias("confidence_sum"), "occupancy_sum", "occupancy_max", "occupancy_last", *counters)


def stream_queue_minutes(frames: DataFrame, late: str = "10 minutes", warning: float = 300.0, critical: float = 600.0) -> DataFrame:
    """Queue-minutes that grow while their minute lasts (update mode), as ``minutes.queue_minutes`` has them.

    The state of a minute is its counts, sums, first and last counters, and its samples that told a wait.
    """
    kinds = dict(frames.dtypes)
    cut = lambda c: F.greatest(F.col(c), F.lit(0).cast(kinds[c])).alias(c)
    rows = frames.withColumns({"length": cut("length"), "wait": F.when(F.col("wait").isNotNull(), cut("wait"))})
    first, last = (lambda c: F.min_by(c, "at")), (lambda c: F.max_by(c, "at"))
    rows = rows.withWatermark("at", late).groupBy("camera_id", "queue_id", F.window("at", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("length").alias("length_sum"), F.max("length").alias("length_max"), last("length").alias("length_last"),
        F.coalesce(F.sum("wait"), F.lit(0.0)).alias("wait_sum_seconds"), F.count("wait").alias("wait_sample_count"), F.greatest(last("completed") - first("completed"), F.lit(0)).alias("throughput"),
        F.count_if(F.col("wait") >= warning).alias("warning_samples"), F.count_if(F.col("wait") >= critical).alias("critical_samples"),
        F.coalesce(F.sum(F.abs("speed_m") * 60), F.lit(0.0)).alias("movement_speed_sum_mpm"), F.count("speed_m").alias("movement_speed_samples"), F.collect_list(F.struct("at", "completed", "last_wait")).alias("seen"),
    )
    seen = F.sort_array("seen")
    before = lambda k: F.coalesce(F.get(seen, k - 1)["completed"], F.lit(0))
    waits = F.transform(seen, lambda s, k: F.when(s["completed"] > F.when(k == 0, 0).otherwise(before(k)), s["last_wait"]))
    rows = rows.withColumn("completed_waits", F.array_compact(waits)).withColumn("physically_calibrated", F.col("movement_speed_samples") > 0)
    met = F.size(F.filter("completed_waits", lambda w: w <= warning)).cast("long").alias("sla_met")
    return rows.select("*", met).withColumn("bucket_start", F.col("w.start")).drop("w", "seen")


def stream_minute_events(events: DataFrame, late: str = "10 minutes", most: int = 500) -> DataFrame:
    """The newest events of each camera-minute (update mode): camera_id, bucket_start, events, in order of time.

    ``events``: camera_id, occurred_at, event_id, kind. Severity and metric key are added, as ``minutes.minute_events`` has them.
    """
    item = F.struct("occurred_at", "event_id", "kind", G.event_severity(F.col("kind")).alias("severity"), G.event_metric_key(F.col("kind")).alias("metric_key"))
    rows = events.withColumn("item", item).withWatermark("occurred_at", late).groupBy("camera_id", F.window("occurred_at", "1 minute").alias("w"))
    rows = rows.agg(F.collect_set("item").alias("events"))
    return rows.select("camera_id", F.col("w.start").alias("bucket_start"), F.slice(F.sort_array("events", asc=False), 1, most).alias("events")).withColumn("events", F.sort_array("events"))


def replace_days(new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], path: str, staged: str, batch: int) -> None:
    """Merge ``new`` into the days of ``path`` that it touches.

    The merged days are written apart first, under the stream's checkpoint, then put in place. A
    batch that is replayed after its days were complete only puts them in place again, so a crash
    between the two steps loses nothing. The stage of the batch before, which is through, goes.
    """
    spark, stage = new.sparkSession, f"{staged}/{batch}"
    if not exists(spark, f"{stage}/_SUCCESS"):
        days = new.select("day").distinct()
        old = spark.read.schema(new.schema).parquet(path).join(days, "day", "left_semi").select(*new.columns) if exists(spark, path) else new.limit(0)
        merge(old, new).write.mode("overwrite").partitionBy("day").parquet(stage)
    ready = spark.read.schema(new.schema).parquet(stage)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    remove(spark, f"{staged}/{batch - 1}")


def last_of(*key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: facts.upsert_last(old.unionByName(new), list(key))


def first_of(*key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: old.unionByName(facts.insert_ignore(new, old, list(key)))


def stream_ingest(minutes: DataFrame, path: str, checkpoint: str):
    """Keep the last write of each camera and minute under ``path``, by day; replays change nothing."""

    def upsert(batch: DataFrame, n: int) -> None:
        replace_days(batch.withColumn("day", F.to_date("bucket_start")), last_of("camera_id", "bucket_start"), path, f"{checkpoint}/staged", n)

    return minutes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_documents(lines: DataFrame, store: str, checkpoint: str):
    """Camera-minute documents as facts under ``store``; ``lines`` has line and arrival (long, the order of writes).

    Folders minute, queue and spatial keep the last write of each key; wait and event the first of
    each id, which names one day; source has a row for each camera; rejected has the lines that break
    a rule, with the reasons, by batch. Each document is parsed and checked once.
    """

    def ingest(batch: DataFrame, n: int) -> None:
        spark, staged = batch.sparkSession, f"{checkpoint}/staged"
        checked = io.marked(io.parsed(batch))
        checked.write.mode("overwrite").parquet(f"{staged}/checked")
        checked = spark.read.schema(checked.schema).parquet(f"{staged}/checked")
        checked.where(F.size("reasons") > 0).select("line", "arrival", "reasons").write.mode("overwrite").parquet(f"{store}/rejected/batch={n}")
        valid = checked.where(F.size("reasons") == 0).drop("line", "reasons")
        found = {kind: io.snake(rows) for kind, rows in io.explode_minutes(valid).items() if kind != "wait"}
        start = F.to_timestamp("bucketStart").alias("bucket_start")
        queues = valid.select(F.col("cameraId").alias("camera_id"), start, "arrival", F.explode("queues").alias("q"))
        waits = facts.wait_events(queues.select("camera_id", "bucket_start", F.col("q.queueId").alias("queue_id"), F.col("q.completedWaitSeconds").alias("completed_waits")))
        plan = [
            (found["minute"], "minute", "bucket_start", last_of("camera_id", "bucket_start")),
            (found["queue"], "queue", "bucket_start", last_of("camera_id", "queue_id", "bucket_start")),
            (found["spatial"], "spatial", "bucket_start", last_of("camera_id", "zone_id", "layer", "bucket_start")),
            (waits.withColumn("arrival", F.lit(0).cast("long")), "wait", "occurred_at", first_of("event_id")),
            (found["event"].withColumn("occurred_at", F.to_timestamp("occurred_at")), "event", "occurred_at", first_of("event_id")),
        ]
        for rows, kind, time, merge in plan:
            replace_days(rows.withColumn("day", F.to_date(time)), merge, f"{store}/{kind}", f"{staged}/{kind}", n)
        name = F.coalesce("cameraName", "cameraId")
        new = valid.groupBy(F.col("cameraId").alias("camera_id")).agg(F.max_by(name, "arrival").alias("name"), F.coalesce(F.bool_or("physicallyCalibrated"), F.lit(False)).alias("calibrated"))
        path, stage = f"{store}/source", f"{staged}/source/{n}"
        if not exists(spark, f"{stage}/_SUCCESS"):
            old = spark.read.schema(new.schema).parquet(path) if exists(spark, path) else new.limit(0)
            facts.merge_camera_sources(old, new).write.mode("overwrite").parquet(stage)
        spark.read.schema(new.schema).parquet(stage).write.mode("overwrite").parquet(path)
        remove(spark, f"{staged}/source/{n - 1}")

    return lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = place(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = place(spark, path)
    files.delete(at, True)


def stream_rollups(minutes: DataFrame, cameras: DataFrame, store: str, path: str, checkpoint: str):
    """Recompute the rollups of the days that a batch touches, from the minutes kept in ``store``."""

    def refresh(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("bucket_start").alias("day")).distinct()
        kept = batch.sparkSession.read.parquet(store).join(days, "day", "left_semi")
        facts.write_hours(facts.location_hours(kept, cameras), path)

    return minutes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
