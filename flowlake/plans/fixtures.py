"""Domain tables derived from the star-schema tables, the same arithmetic in Spark and in SQL.

Every function reads whole tables. ``SQL`` has the DuckDB form of each as the body of a common table
expression; ``with_sql`` puts those that a query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import geometry as G

WIDTH = HEIGHT = 101
SQUARE = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]
WEDGE = [(0.1, 0.1), (0.9, 0.1), (0.5, 0.5), (0.9, 0.9), (0.1, 0.9)]
DOOR = ((0.2, 0.5), (0.8, 0.5))
GATE = ((0.5, 0.2), (0.5, 0.8))
HYSTERESIS = 0.03
HOMOGRAPHY = [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tracked person and frame, several where the tracker repeated itself."""
    frame = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).cast("long") - 78_888).alias("frame_index")
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).cast("long").alias("camera_id"),
        F.col("user_id").alias("track_id"),
        frame,
        ((F.col("event_id") * 37 + F.col("user_id") * 11) % 101).cast("double").alias("px"),
        F.get_json_object("props", "$.k").cast("int").cast("double").alias("py"),
        (F.col("event_type") != "error").alias("confirmed"),
        (F.lit(0.5) + (F.col("event_id") % 50) / F.lit(100.0)).alias("confidence"),
        F.col("event_id").alias("arrival"),
    )
    return rows.withColumns(
        {"ts": F.col("frame_index").cast("double"), "x1": F.col("px") - 3, "y1": F.col("py") - 12, "x2": F.col("px") + 3, "y2": F.col("py")}
    )


def frames(obs: DataFrame) -> DataFrame:
    """The frame clock: every camera's frames, with or without confirmed people."""
    return obs.select("camera_id", "frame_index", "ts").distinct()


def camera_ids(obs: DataFrame) -> DataFrame:
    return obs.select("camera_id").distinct()


def zones(obs: DataFrame) -> DataFrame:
    """camera_id, zone_id and pixel polygon: a floor for every camera, a wedge for those with even ids."""
    shape = lambda name, points: F.struct(F.lit(name).alias("zone_id"), G.literal_polygon(points).alias("shape"))
    rows = camera_ids(obs).select("camera_id", F.inline(F.array(shape("floor", SQUARE), shape("wedge", WEDGE))))
    return rows.where("zone_id = 'floor' or camera_id % 2 = 0").select("camera_id", "zone_id", G.pixel_polygon(F.col("shape"), WIDTH, HEIGHT).alias("polygon"))


def lines(obs: DataFrame) -> DataFrame:
    """A level door for every camera, an upright gate for those with odd ids."""
    point = lambda p: G.point(F.lit(p[0]), F.lit(p[1]))
    line = lambda name, ends: F.struct(F.lit(name).alias("line_id"), point(ends[0]).alias("start"), point(ends[1]).alias("end"))
    rows = camera_ids(obs).select("camera_id", F.inline(F.array(line("door", DOOR), line("gate", GATE)))).where("line_id = 'door' or camera_id % 2 = 1")
    return rows.withColumns({"hysteresis": F.lit(HYSTERESIS), "positive": F.lit("entry"), "negative": F.lit("exit")})


def box(low: Column, high: Column) -> Column:
    """The square from ``low`` to ``high`` on both axes, in pixels."""
    return F.array(*[G.point(x, y) for x, y in ((low, low), (high, low), (high, high), (low, high))])


def regions(obs: DataFrame) -> DataFrame:
    """camera_id, zone_id, polygon, dwell: a secure square, elsewhere on odd cameras, and a store for every third camera."""
    low = F.when(F.col("camera_id") % 2 == 0, F.lit(20.0)).otherwise(F.lit(10.0))
    region = lambda name, low, dwell: F.struct(F.lit(name).alias("zone_id"), box(low, low + 60.0).alias("polygon"), F.lit(dwell).alias("dwell"))
    rows = camera_ids(obs).select("camera_id", F.inline(F.array(region("secure", low, 1.0), region("store", F.lit(30.0), 2.0))))
    return rows.where("zone_id = 'secure' or camera_id % 3 = 0")


def areas(obs: DataFrame) -> DataFrame:
    """The regions as restricted areas; the store is on duty in the first minute of Thursday only."""
    on = lambda v, t: F.when(F.col("zone_id") == "store", v).cast(t)
    return regions(obs).withColumns(
        {"grace": F.lit(1.0), "cooldown": F.lit(10.0), "days": on(F.array(F.lit(3)), "array<int>"), "from_minute": on(F.lit(0), "int"), "to_minute": on(F.lit(1), "int"), "timezone": on(F.lit("UTC"), "string")}
    )


def queues(obs: DataFrame) -> DataFrame:
    """The regions as queues."""
    rows = regions(obs).withColumnRenamed("zone_id", "queue_id")
    matrix = F.array(*map(F.lit, HOMOGRAPHY))
    return rows.withColumns({"homography": matrix, "max_speed": F.lit(45.0), "gap": F.lit(1.0), "service": G.point(F.lit(0.8), F.lit(0.5)), "radius": F.lit(0.08), "alpha": F.lit(0.5), "overflow": F.lit(3)})


def square() -> Column:
    """The pixel polygon of the floor."""
    return G.literal_polygon([(x * (WIDTH - 1), y * (HEIGHT - 1)) for x, y in SQUARE])


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera-minutes with their queue measures; keys repeat on purpose, ``arrival`` orders them."""
    c = F.col
    wait = (c("l_orderkey") * 13 + c("l_partkey") * 7 + c("l_linenumber") * 101) % 900
    minute = (c("l_orderkey") % 14) * 1440 + (c("l_partkey") % 24) * 60 + (c("l_orderkey") * 7 + c("l_linenumber")) % 60
    count = c("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("camera_id"),
        minute.alias("minute_index"),
        (((c("l_orderkey") * 10 + c("l_linenumber")) * 100000 + c("l_partkey")) * 100 + c("l_quantity").cast("long")).alias("arrival"),
        count.alias("sample_count"),
        F.lit(50).cast("long").alias("expected_samples"),
        (count * (c("l_partkey") % 9)).alias("occupancy_sum"),
        (c("l_partkey") % 9 + 1).alias("occupancy_max"),
        (c("l_partkey") % 9).alias("occupancy_last"),
        (c("l_partkey") % 20).alias("entries"),
        (c("l_orderkey") % 18).alias("exits"),
        wait.alias("wait_seconds"),
        c("l_returnflag").alias("queue_id"),
        F.get(F.array(*map(F.lit, ("occupancy", "dwell", "traffic", "congestion"))), (c("l_linenumber") % 4).cast("int")).alias("layer"),
        (c("l_partkey") % 4 * 25).alias("xa"),
        (c("l_orderkey") % 3 * 33).alias("ya"),
        (c("l_partkey") % 5 * 20).alias("xb"),
        (c("l_orderkey") % 4 * 25).alias("yb"),
    )
    start = F.timestamp_seconds(F.lit(1_704_067_200) + c("minute_index") * 60)
    return rows.withColumn("bucket_start", start)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera catalogue with its field, market and booth."""
    c = F.col
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = supplier.join(nation, c("s_nationkey") == c("n_nationkey"))
    booth = F.when(c("s_suppkey") % 5 != 0, c("s_nationkey") * 10 + c("s_suppkey") % 2)
    return rows.select(
        c("s_suppkey").alias("camera_id"),
        c("s_name").alias("name"),
        c("n_regionkey").cast("string").alias("field_id"),
        c("s_nationkey").cast("string").alias("market_id"),
        booth.cast("string").alias("booth_id"),
        (c("s_suppkey") % 11 != 0).alias("enabled"),
        (c("s_suppkey") % 4 != 0).alias("calibrated"),
    )


def analytics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of cameras, by kind."""
    kinds = {"error": "restricted_area_confirmed", "purchase": "queue_overflow_started", "signup": "queue_overflow_ended", "click": "line_crossed", "view": "restricted_area_entered"}
    size = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_cameras"))
    rows = table(spark, sf_dir, "events").join(F.broadcast(size))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return rows.select("event_id", (F.col("user_id") % F.col("n_cameras")).alias("camera_id"), F.col("ts").cast("timestamp").alias("occurred_at"), kind.alias("kind"))


#: Whether a sample (n) of a track is within 60 pixels a second of the last one accepted (f).
FITS = "(len(f.kept) = 0 or sqrt((n.px - f.kept[-1].x) * (n.px - f.kept[-1].x) + (n.py - f.kept[-1].y) * (n.py - f.kept[-1].y)) / (n.ts - f.kept[-1].t) <= 60)"

SQL = {
    "obs": """
  select *, frame_index::double as ts, px - 3 as x1, py - 12 as y1, px + 3 as x2, py as y2 from (
    select user_id // 10 as camera_id, user_id as track_id, epoch_us(ts) // 21600000000 - 78888 as frame_index,
           ((event_id * 37 + user_id * 11) % 101)::double as px, json_extract_string(props, '$.k')::int::double as py,
           event_type <> 'error' as confirmed, 0.5::double + (event_id % 50) / 100.0::double as confidence, event_id as arrival
    from events)""",
    "frames": "select distinct camera_id, frame_index, ts from obs",
    "seen": "select * from obs where confirmed qualify row_number() over (partition by camera_id, frame_index, track_id order by arrival desc) = 1",
    "judged": f"""
  select camera_id, track_id, k, frame_index, ts, px, py, [{{'t': ts, 'x': px, 'y': py}}] as kept, true as ok, null::double as bx, null::double as by_, null::double as bt
  from (select *, row_number() over (partition by camera_id, track_id order by ts) as k from seen) where k = 1
  union all
  select n.camera_id, n.track_id, n.k, n.frame_index, n.ts, n.px, n.py,
         list_filter(case when {FITS} then list_append(f.kept, {{'t': n.ts, 'x': n.px, 'y': n.py}}) else f.kept end, lambda s: s.t >= n.ts - 3), {FITS}, f.px, f.py, f.ts
  from judged f join (select *, row_number() over (partition by camera_id, track_id order by ts) as k from seen) n on n.camera_id = f.camera_id and n.track_id = f.track_id and n.k = f.k + 1""",
    "speeds": """
  select *, coalesce(speed_px, sqrt(vx * vx + vy * vy), sqrt((px - bx) * (px - bx) + (py - by_) * (py - by_)) / (ts - bt)) as judged_
  from (
    select *, case when ok and span > 0 then case when far < 2 then 0 else far / span end end as speed_px, case when ok and span > 0 then case when far < 2 then 0 else far / 10 / span end end as speed_m,
           case when not ok then 'pixel jump' when span <= 0 then 'too little history' end as reason,
           case when span > 0 then (kept[-1].x - kept[1].x) / span end as vx, case when span > 0 then (kept[-1].y - kept[1].y) / span end as vy, kept[-1].x / 10 as at_x, kept[-1].y / 10 as at_y
    from (
      select *, case when len(kept) > 1 then kept[-1].t - kept[1].t else 0 end as span,
             coalesce(list_sum(list_transform(range(1, len(kept)), lambda i: sqrt((kept[i + 1].x - kept[i].x) * (kept[i + 1].x - kept[i].x) + (kept[i + 1].y - kept[i].y) * (kept[i + 1].y - kept[i].y)))), 0) as far
      from judged))""",
    "regions": """
  select distinct camera_id, 'secure' as zone_id, case when camera_id % 2 = 0 then 20 else 10 end as lo, 1 as dwell from frames
  union all select distinct camera_id, 'store', 30, 2 from frames where camera_id % 3 = 0""",
    "minutes": """
  select *, timestamp '2024-01-01 00:00:00' + to_minutes(minute_index) as bucket_start from (
    select l_suppkey as camera_id, (l_orderkey % 14) * 1440 + (l_partkey % 24) * 60 + (l_orderkey * 7 + l_linenumber) % 60 as minute_index,
           ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + l_quantity::bigint as arrival, l_quantity::bigint as sample_count, 50::bigint as expected_samples,
           l_quantity::bigint * (l_partkey % 9) as occupancy_sum, l_partkey % 9 + 1 as occupancy_max, l_partkey % 9 as occupancy_last,
           l_partkey % 20 as entries, l_orderkey % 18 as exits, (l_orderkey * 13 + l_partkey * 7 + l_linenumber * 101) % 900 as wait_seconds,
           l_returnflag as queue_id, ['occupancy', 'dwell', 'traffic', 'congestion'][l_linenumber % 4 + 1] as layer,
           l_partkey % 4 * 25 as xa, l_orderkey % 3 * 33 as ya, l_partkey % 5 * 20 as xb, l_orderkey % 4 * 25 as yb
    from lineitem)""",
    "minute": "select * from minutes qualify row_number() over (partition by camera_id, minute_index order by arrival desc) = 1",
    "queue_minute": "select * from minutes qualify row_number() over (partition by camera_id, queue_id, minute_index order by arrival desc) = 1",
    "cams": """
  select s_suppkey as camera_id, s_name as name, n_regionkey::varchar as field_id, s_nationkey::varchar as market_id,
         case when s_suppkey % 5 <> 0 then (s_nationkey * 10 + s_suppkey % 2)::varchar end as booth_id, s_suppkey % 11 <> 0 as enabled, s_suppkey % 4 <> 0 as calibrated
  from supplier join nation on s_nationkey = n_nationkey""",
    "feed": """
  select event_id, user_id % (select count(*) from supplier) as camera_id, ts::timestamp as occurred_at,
         case event_type when 'error' then 'restricted_area_confirmed' when 'purchase' then 'queue_overflow_started' when 'signup' then 'queue_overflow_ended'
                         when 'click' then 'line_crossed' when 'view' then 'restricted_area_entered' end as kind
  from events""",
}


def with_sql(*needs: str, body: str, recursive: bool = False) -> str:
    """A query behind the fixtures that it names; ``body`` begins by closing the last of them."""
    parts = ",\n".join(f"{n} as ({SQL[n]})" for n in needs)
    return f"with {'recursive ' * recursive}" + parts.removesuffix(")") + body
