"""Readers and writers: tracking and detection logs, ground truth, camera files, minute bundles."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import geometry as G

TRACKING = "frame_index bigint, timestamp_seconds double, tracks array<struct<track_id:bigint,xyxy:array<double>,confidence:double,confirmed:boolean>>, expired_track_ids array<bigint>"
DETECTIONS = "frame_index bigint, timestamp double, source_index bigint, detections array<struct<xyxy:array<double>,confidence:double,class_id:int,class_name:string>>"
POINTS = "array<struct<x:double,y:double,value:double,intensity:double>>"
SPATIAL = f"struct<zoneId:string,zoneName:string,layer:string,bucketSeconds:bigint,coveragePercent:double,points:{POINTS}>"
QUEUE = (
    "struct<queueId:string,queueName:string,sampleCount:bigint,lengthSum:double,lengthMax:bigint,lengthLast:bigint,waitSumSeconds:double,waitSampleCount:bigint,completedWaitSeconds:array<double>,"
    "throughput:bigint,slaMet:bigint,warningSamples:bigint,criticalSamples:bigint,movementSpeedSumMpm:double,movementSpeedSamples:bigint,physicallyCalibrated:boolean>"
)
EVENT = "struct<eventId:string,eventType:string,severity:string,title:string,occurredAt:string,metricKey:string,value:double,payload:map<string,string>>"
#: bucketStart stays text, so that a missing time zone can be told.
MINUTES = (
    "cameraId string, cameraName string, bucketStart string, sampleCount bigint, expectedSamples bigint, confidenceSum double, occupancySum double, occupancyMax bigint, occupancyLast bigint, "
    f"entries bigint, exits bigint, uniqueVisitors bigint, physicallyCalibrated boolean, queues array<{QUEUE}>, spatial array<{SPATIAL}>, events array<{EVENT}>"
)


def corners(box: Column) -> list[Column]:
    return [F.get(box, F.lit(k)).alias(name) for k, name in enumerate(("x1", "y1", "x2", "y2"))]


def read_tracking(spark: SparkSession, path: str, camera_id: int) -> DataFrame:
    """One row for each track and frame, a row of nulls for a frame without tracks."""
    rows = spark.read.schema(TRACKING).json(path)
    rows = rows.select(F.lit(camera_id).cast("long").alias("camera_id"), "frame_index", F.col("timestamp_seconds").alias("ts"), "expired_track_ids", F.explode_outer("tracks").alias("t"))
    return rows.select("camera_id", "frame_index", "ts", F.col("t.track_id").alias("track_id"), *corners(F.col("t.xyxy")), F.col("t.confidence").alias("confidence"), F.col("t.confirmed").alias("confirmed"), "expired_track_ids")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(DETECTIONS).json(path).where("frame_index is not null")
    rows = rows.select("frame_index", "timestamp", F.coalesce("source_index", "frame_index").alias("source_index"), F.posexplode_outer("detections").alias("at", "d"))
    return rows.select(
        "frame_index", "timestamp", "source_index", "at", *corners(F.col("d.xyxy")), F.col("d.confidence").alias("confidence"),
        F.when(F.col("d").isNotNull(), F.coalesce("d.class_id", F.lit(0))).alias("class_id"), F.when(F.col("d").isNotNull(), F.coalesce("d.class_name", F.lit("person"))).alias("class_name"),
    )


def write_detections(rows: DataFrame, path: str) -> None:
    """The inverse: a nested row for each frame."""
    item = F.when(F.col("x1").isNotNull(), F.struct("at", F.array("x1", "y1", "x2", "y2").alias("xyxy"), "confidence", "class_id", "class_name"))
    nested = rows.groupBy("frame_index", "timestamp", "source_index").agg(F.sort_array(F.collect_list(item)).alias("d"))
    nested.select("frame_index", "timestamp", "source_index", F.transform("d", lambda s: s.dropFields("at")).alias("detections")).write.mode("overwrite").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """frame_index, track_id and corners from lines of numbers, either xywh from frame 1 or xyxy."""
    line = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not line like '#%'")
    parts = line.select(F.filter(F.split("line", r"[ ,]+"), lambda s: s != "").alias("p")).where(F.size("p") >= 6)
    n = parts.select(*[F.get("p", F.lit(k)).cast("double").alias(name) for k, name in enumerate(("frame", "track", "x", "y", "w", "h"))])
    whole = (F.col("w") > F.col("x")) & (F.col("h") > F.col("y"))
    frame = F.col("frame").cast("long")
    return n.select(
        F.when(whole, frame).otherwise(F.greatest(frame - 1, F.lit(0))).alias("frame_index"), F.col("track").cast("long").alias("track_id"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.when(whole, F.col("w")).otherwise(F.col("x") + F.col("w")).alias("x2"), F.when(whole, F.col("h")).otherwise(F.col("y") + F.col("h")).alias("y2"),
    )


POINT = "array<struct<x:double,y:double>>"
CAMERA = f"camera_id string, zones array<struct<kind:string,id:string,polygon:{POINT},settings:map<string,string>>>, calibration struct<image:{POINT},ground:{POINT},unit:string>, error string"


def read_camera_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each camera file: its zones, lines and queues with their settings, and calibration."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        points = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps or []]
        for batch in batches:
            out = []
            for text in batch["value"]:
                try:
                    doc = yaml.safe_load(text)
                    analytics, zones = doc.get("analytics") or {}, []
                    for kind, key in (("occupancy", "occupancy_zones"), ("restricted", "restricted_zones"), ("line", "counting_lines"), ("queue", "queues")):
                        for z in analytics.get(key) or []:
                            shape = z.get("points") or z.get("polygon") or [z["start"], z["end"]]
                            rest = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in z.items() if k not in ("id", "points", "polygon", "start", "end")}
                            zones.append({"kind": kind, "id": z["id"], "polygon": points(shape), "settings": rest})
                    cal = doc.get("calibration")
                    cal = cal and {"image": points(cal["image_points"]), "ground": points(cal["ground_points"]), "unit": cal.get("ground_unit")}
                    out.append((str(doc["camera"]["id"]), zones, cal, None))
                except Exception as e:  # a bad file is a row with its error, not a failed job
                    out.append((None, [], None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["camera_id", "zones", "calibration", "error"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, CAMERA)


# What a camera file means where it says nothing.
DEFAULTS = {
    "restricted": {"entry_dwell_seconds": 1.0, "exit_grace_seconds": 1.0, "alert_cooldown_seconds": 30.0},
    "line": {"hysteresis": 0.01, "positive_label": "entry", "negative_label": "exit"},
    "queue": {"minimum_dwell_seconds": 2.0, "maximum_speed_pixels_per_second": 40.0, "gap_tolerance_seconds": 1.0, "service_completion_radius": 0.08, "count_smoothing_alpha": 0.35},
}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def layout(configs: DataFrame, kind: str, size: tuple[int, int]) -> DataFrame:
    """The configuration rows that the operators join by camera, from ``read_camera_configs``.

    occupancy: zones; restricted: areas with their schedules; line: lines; queue: queues. Settings
    that a file leaves out have the usual values. ``size`` is the width and height of the frames.
    """
    rows = configs.where("error is null").select("camera_id", F.explode("zones").alias("z")).where(F.col("z.kind") == kind)
    polygon = G.pixel_polygon(F.col("z.polygon"), *size).alias("polygon")

    def told(name: str, as_: str, kind_: str = "double") -> Column:
        given = F.get(F.map_values(F.map_filter("z.settings", lambda k, _: k == name)), F.lit(0)).cast(kind_)
        return F.coalesce(given, F.lit(DEFAULTS[kind].get(name)).cast(kind_)).alias(as_)

    if kind == "occupancy":
        return rows.select("camera_id", F.col("z.id").alias("zone_id"), polygon)
    if kind == "restricted":
        on = F.from_json(told("active_schedule", "s", "string"), "start string, end string, weekdays array<string>, timezone string")
        rows = rows.select("camera_id", F.col("z.id").alias("zone_id"), polygon, told("entry_dwell_seconds", "dwell"), told("exit_grace_seconds", "grace"), told("alert_cooldown_seconds", "cooldown"), on.alias("s"))
        minute = lambda at: F.split(at, ":")[0].cast("int") * 60 + F.split(at, ":")[1].cast("int")
        day = lambda d: F.coalesce(d.try_cast("int"), F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(d)).cast("int") - 1)
        days = F.when(F.col("s").isNotNull(), F.coalesce(F.transform("s.weekdays", day), F.array(*map(F.lit, range(7)))))
        return rows.withColumns({"days": days, "from_minute": minute(F.col("s.start")), "to_minute": minute(F.col("s.end")), "timezone": F.coalesce("s.timezone", F.lit("UTC"))}).drop("s")
    if kind == "line":
        return rows.select(
            "camera_id", F.col("z.id").alias("line_id"), F.col("z.polygon")[0].alias("start"), F.col("z.polygon")[1].alias("end"),
            told("hysteresis", "hysteresis"), told("positive_label", "positive", "string"), told("negative_label", "negative", "string"),
        )
    service = F.from_json(told("service_point", "s", "string"), "point array<double>")["point"]
    return rows.select(
        "camera_id", F.col("z.id").alias("queue_id"), polygon, told("minimum_dwell_seconds", "dwell"), told("maximum_speed_pixels_per_second", "max_speed"), told("gap_tolerance_seconds", "gap"),
        G.point(service[0], service[1]).alias("service"), told("service_completion_radius", "radius"), told("count_smoothing_alpha", "alpha"), told("overflow_threshold", "overflow", "int"),
    )


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Nested camera-minutes, one JSON object a line, with the line itself for the key check."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return parsed(rows.withColumnRenamed("value", "line"))


def parsed(rows: DataFrame) -> DataFrame:
    """``line``, its fields, ``keys`` (its top-level names) and other columns. The generator keeps the optimiser from parsing again for each use."""
    others = [c for c in rows.columns if c != "line"]
    once = F.struct(F.from_json("line", MINUTES).alias("m"), F.json_object_keys("line").alias("keys"))
    return rows.select(F.explode(F.array(once)).alias("o"), "line", *others).select("o.m.*", "o.keys", "line", *others)


def rules() -> list[tuple[str, Column]]:
    """The name of each rule and whether a camera-minute breaks it."""
    c = F.col
    text = lambda v, most: v.isNull() | (F.length(v) < 1) | (F.length(v) > most)
    low = lambda v: F.coalesce(v < 0, F.lit(False))
    out = lambda v, a, b: v.isNull() | (v < a) | (v > b)
    any_ = lambda name, f: F.coalesce(F.exists(name, f), F.lit(False))
    known = ["cameraId", "cameraName", "bucketStart", "sampleCount", "expectedSamples", "confidenceSum", "occupancySum", "occupancyMax", "occupancyLast", "entries", "exits", "uniqueVisitors", "physicallyCalibrated", "queues", "spatial", "events"]
    return [
        ("not_json", c("keys").isNull()),
        ("unknown_key", F.size(F.array_except(c("keys"), F.array(*map(F.lit, known)))) > 0),
        ("camera_id", text(c("cameraId"), 128)),
        ("camera_name", F.length("cameraName") > 200),
        ("bucket_start", c("bucketStart").isNull() | ~c("bucketStart").rlike(r"(Z|[+-]\d{2}:?\d{2})$") | F.try_to_timestamp("bucketStart").isNull()),
        ("sample_count", out(c("sampleCount"), 0, 3600)),
        ("expected_samples", out(c("expectedSamples"), 1, 3600)),
        ("confidence_sum", out(F.coalesce("confidenceSum", F.lit(0)), 0, 3600)),
        ("negative", low(c("occupancySum")) | low(c("occupancyMax")) | low(c("occupancyLast")) | low(c("entries")) | low(c("exits")) | low(c("uniqueVisitors"))),
        ("too_many_queues", F.size("queues") > 100),
        ("too_many_spatial", F.size("spatial") > 32),
        ("too_many_events", F.size("events") > 500),
        ("queue", any_("queues", lambda q: text(q["queueId"], 128) | text(q["queueName"], 200) | out(q["sampleCount"], 0, 3600) | out(q["lengthSum"], 0, 1e300) | out(F.coalesce(q["waitSampleCount"], F.lit(0)), 0, 1000) | low(q["waitSumSeconds"]) | low(q["throughput"]) | low(q["slaMet"]) | (F.size(q["completedWaitSeconds"]) > 500))),
        ("layer", any_("spatial", lambda s: s["layer"].isNull() | ~s["layer"].isin("occupancy", "dwell", "traffic", "congestion"))),
        ("spatial", any_("spatial", lambda s: out(F.coalesce(s["bucketSeconds"], F.lit(900)), 300, 3600) | out(F.coalesce(s["coveragePercent"], F.lit(0)), 0, 100) | s["points"].isNull() | (F.size(s["points"]) > 256))),
        ("point", any_("spatial", lambda s: F.exists(s["points"], lambda p: out(p["x"], 0, 100) | out(p["y"], 0, 100) | p["value"].isNull() | out(p["intensity"], -1, 1)))),
        ("event", any_("events", lambda e: text(e["eventId"], 128) | text(e["eventType"], 128) | text(e["title"], 300) | ~F.coalesce(e["severity"], F.lit("info")).isin("critical", "warning", "info") | F.try_to_timestamp(e["occurredAt"]).isNull())),
    ]


def marked(rows: DataFrame) -> DataFrame:
    """The rows with ``reasons``: the rules that each breaks, none for a valid one."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules()]))).drop("keys")


def validate_minutes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with ``reasons``."""
    rows = marked(rows)
    return rows.where(F.size("reasons") == 0).drop("reasons", "line"), rows.where(F.size("reasons") > 0)


def explode_minutes(rows: DataFrame) -> dict[str, DataFrame]:
    """The facts of valid minutes: minute, queue, wait, spatial and event rows, with ``arrival`` where there is one."""
    start = F.to_timestamp("bucketStart").alias("bucket_start")
    key = [F.col("cameraId").alias("camera_id"), start, *(["arrival"] if "arrival" in rows.columns else [])]
    names = rows.select(*key).columns
    minute = rows.select(*key, "sampleCount", "expectedSamples", F.coalesce("confidenceSum", F.lit(0.0)).alias("confidenceSum"), F.coalesce("occupancySum", F.lit(0.0)).alias("occupancySum"), "occupancyMax", "occupancyLast", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("exits", F.lit(0)).alias("exits"), "uniqueVisitors")
    queue = rows.select(*key, F.explode("queues").alias("q")).select(*names, "q.*")
    wait = queue.select("camera_id", "bucket_start", F.col("queueId").alias("queue_id"), F.posexplode("completedWaitSeconds").alias("index", "wait_seconds"))
    spatial = rows.select(*key, F.explode("spatial").alias("s")).select(*names, "s.*")
    event = rows.select(*key, F.explode("events").alias("e")).drop("bucket_start").select("*", "e.*").drop("e")
    return {"minute": minute, "queue": queue.drop("completedWaitSeconds"), "wait": wait, "spatial": spatial, "event": event}


def minute_parts(rows: DataFrame) -> DataFrame:
    """kind, name, value of every queue, wait and list of points of valid minutes, by one pass over them."""
    part = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    queues = F.transform("queues", lambda q: part("queue", q["queueId"], q["sampleCount"]))
    waits = F.flatten(F.transform("queues", lambda q: F.transform(F.coalesce(q["completedWaitSeconds"], F.array().cast("array<double>")), lambda w: part("wait", q["queueId"], w))))
    spatial = F.transform("spatial", lambda s: part("spatial", s["layer"], F.size(s["points"])))
    none = F.array().cast("array<struct<kind:string,name:string,value:double>>")
    return rows.select(F.inline(F.concat(*[F.coalesce(p, none) for p in (queues, waits, spatial)])))


def snake(rows: DataFrame) -> DataFrame:
    """Field names of the documents as column names of the facts."""
    return rows.toDF(*[re.sub(r"(?<!^)([A-Z])", r"_\1", c).lower() for c in rows.columns])


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def frame_table(occupancy: DataFrame, zone_ids: list[str]) -> DataFrame:
    """Wide rows for each frame: one column for each zone."""
    wide = occupancy.groupBy("camera_id", "frame_index").pivot("zone_id", zone_ids).agg(F.first("people"))
    return wide.select("camera_id", "frame_index", *[F.col(z).alias(f"occupancy_{z}") for z in zone_ids])


def write_frame_counts(occupancy: DataFrame, zone_ids: list[str], path: str) -> None:
    frame_table(occupancy, zone_ids).write.mode("overwrite").option("header", True).csv(path)


#: The catalogue's tables: cameras, their links to regions, and regions.
CATALOG = ("camera", "camera_region", "region")


def catalog_tables(spark: SparkSession, source: str, tables: tuple[str, str, str] = CATALOG, number: str | None = None, partitions: int = 8, **options: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a catalogue, from a JDBC url or a folder of Parquet tables.

    With ``number``, a numeric column that every table has, a JDBC table is read in as many ranges of it
    as there are partitions, by as many connections; else by one. Columns are named in lower case.
    """
    if not source.startswith("jdbc:"):
        return tuple(spark.read.parquet(f"{source}/{t}.parquet") for t in tables)

    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=source, **options)
        if number is not None:
            bounds = spark.read.format("jdbc").options(url=source, query=f"select min({number}) as low, max({number}) as high from {name}", **options)
            low, high = bounds.load().first()
            if low is not None:
                reader = reader.options(partitionColumn=number, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
        rows = reader.option("dbtable", name).load()
        return rows.toDF(*[c.lower() for c in rows.columns])

    return tuple(map(table, tables))


def read_camera_catalog(cameras: DataFrame, links: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cameras with a url, newest first, and their regions; deleted rows are left out.

    The frames come from ``catalog_tables`` or elsewhere; their filters reach a database or files.
    """
    usable = cameras.where("deleted_at is null and url is not null and trim(url) <> ''").orderBy(F.col("created_at").desc(), "camera_id")
    live = links.where("deleted_at is null").drop("deleted_at").join(regions.where("deleted_at is null").drop("deleted_at"), "region_id")
    return usable, live


def bundle_summary(minutes: DataFrame, queues: DataFrame) -> DataFrame:
    """One row of totals over a bundle of camera-minutes and queue-minutes."""
    m = minutes.agg(
        F.count(F.lit(1)).alias("records"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"), F.max("occupancy_max").alias("peak_occupancy"),
        F.try_divide(F.sum("occupancy_sum").cast("double"), F.sum("sample_count")).alias("average_occupancy"), F.try_divide(F.sum("sample_count") * F.lit(100.0), F.sum("expected_samples")).alias("coverage_percent"),
    )
    q = queues.agg((F.try_divide(F.sum("wait_sum_seconds"), F.sum("wait_sample_count")) / 60).alias("average_wait_minutes"), F.try_divide(F.sum("sla_met") * F.lit(100.0), F.sum("throughput")).alias("sla_percent"))
    return m.join(F.broadcast(q))


def reconcile(summary: DataFrame, expected: DataFrame, tolerance: float = 0.02, percent: float = 0.1) -> DataFrame:
    """key, value, expected, passed: a summary row against expected (key, expected) rows."""
    names = [c for c, t in summary.dtypes if t in ("double", "bigint", "int")]
    rows = summary.select(F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names]))).join(expected, "key")
    limit = F.when(F.col("key").endswith("percent"), percent).otherwise(tolerance)
    return rows.withColumn("passed", F.abs(F.col("value") - F.col("expected")) <= limit)
