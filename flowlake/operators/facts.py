"""Camera-minute facts: keys, catalogue, and the hourly rollups over the location hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("field", "market", "booth")


def upsert_last(facts: DataFrame, key: list[str], arrival: str = "arrival") -> DataFrame:
    """The last write of each key."""
    last = Window.partitionBy(*key).orderBy(F.col(arrival).desc())
    return facts.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def insert_ignore(new: DataFrame, existing: DataFrame | None, key: list[str], arrival: str = "arrival") -> DataFrame:
    """The first write of each key that isn't stored yet."""
    first = Window.partitionBy(*key).orderBy(arrival)
    rows = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows if existing is None else rows.join(existing.select(*key), key, "left_anti")


def wait_events(queue_minutes: DataFrame, waits: str = "completed_waits", target: float = 300.0) -> DataFrame:
    """One event for each completed wait, with an id that a replay repeats: of camera, queue, minute, place and wait."""
    rows = queue_minutes.select("camera_id", "queue_id", "bucket_start", F.posexplode(waits).alias("index", "wait_seconds"))
    stamp = F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ssxxx")
    wait = F.col("wait_seconds").cast("double").cast("string")
    event_id = F.sha2(F.concat_ws(":", "camera_id", "queue_id", stamp, "index", wait), 256)
    return rows.select(event_id.alias("event_id"), "camera_id", "queue_id", F.col("bucket_start").alias("occurred_at"), "wait_seconds", (F.col("wait_seconds") <= target).alias("sla_met"))


def merge_camera_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """camera_id, name, calibrated: a new name wins, calibration stays once known."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col("o.camera_id") == F.col("n.camera_id"), "full_outer")
    no = F.lit(False)
    return rows.select(
        F.coalesce("n.camera_id", "o.camera_id").alias("camera_id"), F.coalesce("n.name", "o.name").alias("name"),
        (F.coalesce("o.calibrated", no) | F.coalesce("n.calibrated", no)).alias("calibrated"),
    )


def exclude_dataset(rows: DataFrame, column: str, prefix: str = "synthetic:", keep: bool = False) -> DataFrame:
    marked = F.col(column).startswith(prefix)
    return rows.where(marked if keep else ~marked)


def purge_expired(facts: DataFrame, time: str, now, days: int) -> DataFrame:
    """The facts of the last ``days`` days before ``now``."""
    return facts.where(F.col(time) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def assemble_catalog(cameras: DataFrame, regions: DataFrame, most: int) -> DataFrame:
    """Cameras (id, name, url) with their regions (camera_id, region_id, kind, polygon) by kind.

    Urls other than rtsp with a path are dropped, as are regions without a polygon.
    """
    usable = cameras.where(F.col("url").rlike(r"^rtsps?://[^/]+/.+"))
    good = regions.where("polygon is not null").groupBy("camera_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "QUEUE", F.struct("region_id", "polygon")))).alias("queues"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "RESTRICTED_AREA", F.struct("region_id", "polygon")))).alias("restricted"),
    )
    rows = usable.join(good, "camera_id", "left").withColumns({k: F.coalesce(k, F.array().cast(dict(good.dtypes)[k])) for k in ("queues", "restricted")})
    signature = F.sha2(F.to_json(F.struct("url", "name", "queues", "restricted")), 256)
    return rows.withColumn("signature", signature).orderBy("camera_id").limit(most)


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """camera_id and its state: added, removed, changed or same, by signature."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col("o.camera_id") == F.col("n.camera_id"), "full_outer")
    state = (
        F.when(F.col("o.camera_id").isNull(), "added").when(F.col("n.camera_id").isNull(), "removed")
        .when(F.col("o.signature") == F.col("n.signature"), "same").otherwise("changed")
    )
    return rows.select(F.coalesce("n.camera_id", "o.camera_id").alias("camera_id"), state.alias("state"))


def camera_sources(cameras: DataFrame) -> DataFrame:
    """The catalogue with each camera's leaf location: booth, else market, else field."""
    leaf = F.coalesce("booth_id", "market_id", "field_id")
    kind = F.when(F.col("booth_id").isNotNull(), "booth").when(F.col("market_id").isNotNull(), "market").otherwise("field")
    return cameras.withColumns({"location_id": leaf, "location_type": kind})


def at_levels(rows: DataFrame) -> DataFrame:
    """Each row once for each level at which its camera has a location."""
    places = F.array(*[F.struct(F.lit(level).alias("location_type"), F.col(f"{level}_id").alias("location_id")) for level in LEVELS])
    return rows.select("*", F.inline(places)).where("location_id is not null")


def location_hours(minutes: DataFrame, cameras: DataFrame) -> DataFrame:
    """Hourly facts of every field, market and booth.

    Cameras are averaged over their own samples first, then added up, so that a camera with more
    samples doesn't weigh more. One aggregation by camera and hour, one by location and hour.
    """
    sums = ["sample_count", "expected_samples", "confidence_sum", "entries", "exits"]
    hourly = minutes.withColumn("confidence_sum", F.col("sample_count")).groupBy("camera_id", F.date_trunc("hour", "bucket_start").alias("bucket_start")).agg(
        F.try_divide(F.sum("occupancy_sum").cast("double"), F.sum("sample_count")).alias("average"), F.max("occupancy_max").alias("peak"), *[F.sum(c).alias(c) for c in sums]
    )
    expected = at_levels(cameras.where("enabled")).groupBy("location_type", "location_id").agg(F.count(F.lit(1)).alias("expected_sources"))
    rows = at_levels(hourly.join(cameras.select("camera_id", "enabled", "field_id", "market_id", "booth_id"), "camera_id"))
    rows = rows.groupBy("location_type", "location_id", "bucket_start").agg(
        F.sum("average").alias("occupancy_sum"), F.sum("peak").alias("occupancy_max"), *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("sample_count") > 0).alias("contributing_sources"),
    )
    rows = rows.join(expected, ["location_type", "location_id"], "left").withColumn("expected_sources", F.coalesce("expected_sources", F.lit(0)))
    return rows.withColumn("unique_visitors", F.when(F.col("expected_sources") == 1, F.col("entries")))


QUEUE_SUMS = ("sample_count", "length_sum", "wait_sum_seconds", "wait_sample_count", "throughput", "sla_met", "warning_samples", "critical_samples", "movement_speed_sum_mpm", "movement_speed_samples")


def queue_location_hours(queue_minutes: DataFrame, cameras: DataFrame) -> DataFrame:
    """Hourly queue measures of every location and queue: one aggregation by camera, queue and hour, one by location."""
    by = ["camera_id", "queue_id", F.date_trunc("hour", "bucket_start").alias("bucket_start")]
    hourly = queue_minutes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in QUEUE_SUMS], F.max("length_max").alias("length_max"), F.max("physically_calibrated").alias("calibrated"))
    rows = at_levels(hourly.join(cameras.select("camera_id", "field_id", "market_id", "booth_id"), "camera_id"))
    rows = rows.groupBy("location_type", "location_id", "queue_id", "bucket_start")
    return rows.agg(*[F.sum(c).alias(c) for c in QUEUE_SUMS], F.max("length_max").alias("length_max"), F.count_if("calibrated").alias("calibrated_sources"))


def refresh_hours(minutes: DataFrame, cameras: DataFrame, now: str, lookback_hours: int = 3) -> DataFrame:
    """The rollup of the hours from ``lookback_hours`` before ``now`` to the one after it."""
    hour = F.date_trunc("hour", F.lit(now).cast("timestamp"))
    low, high = hour - F.make_interval(hours=F.lit(lookback_hours)), hour + F.make_interval(hours=F.lit(1))
    return location_hours(minutes.where((F.col("bucket_start") >= low) & (F.col("bucket_start") < high)), cameras)


def write_hours(hours: DataFrame, path: str) -> None:
    """Replace the days that ``hours`` holds, by partition."""
    rows = hours.withColumn("day", F.to_date("bucket_start"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("location_type", "day").parquet(path)
