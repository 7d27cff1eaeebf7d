"""Compaction of frame metrics to camera-minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G


def camera_minutes(frames: DataFrame, expected: int = 30) -> DataFrame:
    """One row for each camera and minute from (camera_id, at, people, entries, exits).

    Entries and exits are cumulative counters; a minute counts their growth within itself, so the
    first step of a minute is lost, as it is at the source. Minutes without samples give no row.
    """
    rows = frames.where("people is not null").withColumn("people", F.greatest("people", F.lit(0)))
    first, last = (lambda c: F.min_by(c, "at")), (lambda c: F.max_by(c, "at"))
    grown = lambda c: F.greatest(last(c) - first(c), F.lit(0))
    return rows.groupBy("camera_id", F.date_trunc("minute", "at").alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.lit(expected).alias("expected_samples"), F.count(F.lit(1)).alias("confidence_sum"),
        F.sum("people").alias("occupancy_sum"), F.max("people").alias("occupancy_max"), last("people").alias("occupancy_last"), grown("entries").alias("entries"), grown("exits").alias("exits"),
    )


def queue_minutes(frames: DataFrame, warning: float = 300.0, critical: float = 600.0) -> DataFrame:
    """One row for each queue and minute from (camera_id, queue_id, at, length, wait, speed_m, completed, last_wait).

    ``completed`` is cumulative. A wait is noted whenever it has grown since the sample before; the
    count before a minute's first sample is 0, so a minute may note the last wait again. Lengths and
    waits below 0 count as 0.
    """
    minute = F.date_trunc("minute", "at").alias("bucket_start")
    cut = lambda c: F.greatest(F.col(c), F.lit(0).cast(dict(frames.dtypes)[c])).alias(c)
    wait = F.when(F.col("wait").isNotNull(), cut("wait")).alias("wait")  # ``greatest`` passes over nulls
    rows = frames.withColumns({"length": cut("length"), "wait": wait}).select("*", minute)
    before = F.lag("completed", 1, 0).over(Window.partitionBy("camera_id", "queue_id", "bucket_start").orderBy("at"))
    rows = rows.withColumn("new_wait", F.when((F.col("completed") > before) & F.col("last_wait").isNotNull(), F.struct("at", "last_wait")))
    first, last = (lambda c: F.min_by(c, "at")), (lambda c: F.max_by(c, "at"))
    waits = F.transform(F.sort_array(F.collect_list("new_wait")), lambda s: s["last_wait"])
    rows = rows.groupBy("camera_id", "queue_id", "bucket_start").agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("length").alias("length_sum"), F.max("length").alias("length_max"), last("length").alias("length_last"),
        F.coalesce(F.sum("wait"), F.lit(0.0)).alias("wait_sum_seconds"), F.count("wait").alias("wait_sample_count"),
        F.greatest(last("completed") - first("completed"), F.lit(0)).alias("throughput"),
        F.count_if(F.col("wait") >= warning).alias("warning_samples"), F.count_if(F.col("wait") >= critical).alias("critical_samples"),
        F.coalesce(F.sum(F.abs("speed_m") * 60), F.lit(0.0)).alias("movement_speed_sum_mpm"), F.count("speed_m").alias("movement_speed_samples"),
        (F.count("speed_m") > 0).alias("physically_calibrated"), waits.alias("completed_waits"),
    )
    return rows.withColumn("sla_met", F.size(F.filter("completed_waits", lambda w: w <= warning)).cast("long"))


def minute_events(events: DataFrame, most: int = 500) -> DataFrame:
    """The newest events of each camera-minute with severity and metric key."""
    rows = events.withColumn("bucket_start", F.date_trunc("minute", "occurred_at"))
    newest = Window.partitionBy("camera_id", "bucket_start").orderBy(F.col("occurred_at").desc(), F.col("event_id").desc())
    rows = rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")
    return rows.withColumns({"severity": G.event_severity(F.col("kind")), "metric_key": G.event_metric_key(F.col("kind"))})


def region_points(regions: Column) -> Column:
    """Crowded regions (average and bounds as shares of the frame: x1, y1, x2, y2) as points in percent; intensity by the fullest."""
    most = F.aggregate(regions, F.lit(0.0), lambda t, r: F.greatest(t, r["average"].cast("double")))
    most = F.when(most != 0, most).otherwise(1.0)

    def point(r: Column) -> Column:
        value = r["average"].cast("double")
        return F.struct(((r["x1"] + r["x2"]) * 50).alias("x"), ((r["y1"] + r["y2"]) * 50).alias("y"), value.alias("value"), F.least(F.lit(1.0), value / most).alias("intensity"))

    return F.transform(regions, point)


def minute_spatial(points: DataFrame, most: int = 256, regions: DataFrame | None = None) -> DataFrame:
    """The last list of points of each camera, minute and layer, lists of layers cut to ``most`` points.

    ``points``: camera_id, at, layer, points. ``regions``: camera_id, at, regions (average, x1, y1, x2, y2), the
    crowded regions of a frame, stand for the layer ``congestion``; where a frame has that layer itself,
    the layer's list goes. Frames without regions add nothing.
    """
    rows = points.select("camera_id", "at", "layer", F.slice("points", 1, most).alias("points"), F.lit(1).alias("own"))
    if regions is not None:
        found = regions.where(F.size("regions") > 0).select("camera_id", "at", F.lit("congestion").alias("layer"), region_points(F.col("regions")).alias("points"), F.lit(0).alias("own"))
        rows = rows.unionByName(found)
    last = F.max_by("points", F.struct("at", "own")).alias("points")
    return rows.groupBy("camera_id", F.date_trunc("minute", "at").alias("bucket_start"), "layer").agg(last)


def minute_documents(minutes: DataFrame, queues: DataFrame, events: DataFrame, spatial: DataFrame | None = None) -> DataFrame:
    """Camera-minutes with their queues, events and spatial lists nested, each in a fixed order."""
    key = ["camera_id", "bucket_start"]
    nest = lambda f, name: f.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in f.columns if c not in key]))).alias(name))
    rows = minutes.join(nest(queues, "queues"), key, "left").join(nest(events, "events"), key, "left")
    return rows if spatial is None else rows.join(nest(spatial, "spatial"), key, "left")
