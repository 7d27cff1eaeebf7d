"""Queries over scalar rules, detections, minutes compaction, evaluation and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators import detections as D
from flowlake.operators import minutes as M
from flowlake.operators import motion, people
from flowlake.operators.blocks import settled
from flowlake.plans import fixtures as X
from flowlake.plans import management
from flowlake.plans.fixtures import with_sql
from flowlake.sources import io

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


c = F.col
ID = ["camera_id", "track_id", "frame_index", "arrival"]


def obs(spark, sf, *new):
    return X.observations(spark, sf).select(*ID, *new)


query("point_in_polygon", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, px >= 10 and py between 10 and 90 and px <= case when py <= 50 then 100 - py else py end as inside from obs"""))(
    lambda spark, sf: obs(spark, sf, G.point_in_polygon(c("px"), c("py"), G.literal_polygon([(x * 100, y * 100) for x, y in X.WEDGE])).alias("inside"))
)
query("polygon_area_centroid", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, 72 + 6.0::double * (arrival % 5) as area, (4 * px - arrival % 5) / 4 as mx, (4 * py - 24) / 4 as my from obs"""))(
    lambda spark, sf: obs(spark, sf, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((c("x1"), c("y1")), (c("x2"), c("y1")), (c("x2"), c("y2")), (c("x1") - c("arrival") % 5, c("y2")))]).alias("polygon"))
    .select(*ID, G.polygon_area(c("polygon")).alias("area"), G.centroid(c("polygon")).alias("m")).select(*ID, "area", c("m.x").alias("mx"), c("m.y").alias("my"))
)
query("bbox_coverage", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, greatest(least(x2, 80) - greatest(x1, 20), 0) * greatest(least(y2, 80) - greatest(y1, 20), 0) / 72.0::double as coverage from obs"""))(
    lambda spark, sf: obs(spark, sf, G.bbox_coverage(c("x1"), c("y1"), c("x2"), c("y2"), X.square()).alias("coverage"))
)
query("line_side", with_sql("obs", body=") select camera_id, track_id, frame_index, arrival, sign(py - 50)::int as side from obs"))(
    lambda spark, sf: obs(spark, sf, G.line_side(G.point(c("px"), c("py")), G.point(F.lit(20.0), F.lit(50.0)), G.point(F.lit(80.0), F.lit(50.0))).alias("side"))
)
query("iou", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, (6 - arrival % 5) * 12.0::double / (144 - (6 - arrival % 5) * 12.0::double) as iou from obs"""))(
    lambda spark, sf: obs(spark, sf, G.iou(F.struct("x1", "y1", "x2", "y2"), F.struct((c("x1") + c("arrival") % 5).alias("x1"), "y1", (c("x2") + c("arrival") % 5).alias("x2"), "y2")).alias("iou"))
)
TILTED = [0.1, 0.02, 1.0, 0.01, 0.1, 2.0, 0.0005, 0.001, 1.0]
query("project_ground", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, round((0.1::double * px + 0.02::double * py + 1) / (0.0005::double * px + 0.001::double * py + 1), 6) as gx,
       round((0.01::double * px + 0.1::double * py + 2) / (0.0005::double * px + 0.001::double * py + 1), 6) as gy from obs"""))(
    lambda spark, sf: obs(spark, sf, G.project(c("px"), c("py"), F.array(*map(F.lit, TILTED))).alias("g")).select(*ID, F.round("g.x", 6).alias("gx"), F.round("g.y", 6).alias("gy"))
)
query("map_box_ground", with_sql("obs", body=") select camera_id, track_id, frame_index, arrival, px as x, py as y, 4.0::double as xx, 0.0::double as xy, 4.0::double as yy from obs"))(
    lambda spark, sf: obs(spark, sf, G.box_ground(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(None).cast("array<double>")).alias("g")).select(*ID, "g.*")
)
query("foot_point_denormalize", with_sql("obs", body=") select camera_id, track_id, frame_index, arrival, (x1 + x2) / 2 as fx, y2 as fy, confidence * 100 as dx from obs"))(
    lambda spark, sf: obs(spark, sf, G.foot_point(c("x1"), c("x2"), c("y2")).alias("f"), G.denormalize(c("confidence"), c("confidence"), 101, 101).alias("d")).select(*ID, c("f.x").alias("fx"), c("f.y").alias("fy"), c("d.x").alias("dx"))
)
query("grid_cell", with_sql("obs", body=") select camera_id, track_id, frame_index, arrival, least(floor(py / 12.5::double)::int, 7) as row, least(floor(px / 12.5::double)::int, 7) as col from obs where py <= 100 and px <= 100"))(
    lambda spark, sf: obs(spark, sf, G.grid_cell(c("px"), c("py"), 8, 8, (0.0, 0.0, 100.0, 100.0)).alias("cell")).where("cell is not null").select(*ID, c("cell.row").alias("row"), c("cell.col").alias("col"))
)
query("near_service", with_sql("obs", body=""")
select camera_id, track_id, frame_index, arrival, sqrt((px / 100 - 0.8::double) * (px / 100 - 0.8::double) + (py / 100 - 0.5::double) * (py / 100 - 0.5::double)) <= 0.08::double + 1e-9 as near from obs"""))(
    lambda spark, sf: obs(spark, sf, G.near_service(c("px"), c("py"), F.lit(0.8), F.lit(0.5), 101, 101, 0.08).alias("near"))
)
query("schedule_active", """
select event_id, case when isodow in (1, 2, 3, 4, 5, 6) and m >= 1320 or isodow in (7, 2, 3, 4, 5, 6) and isodow <> 1 and m < 360 or isodow = 7 and m < 360 then true else false end as active
from (select event_id, isodow(t) as isodow, hour(t) * 60 + minute(t) as m from (select event_id, ts at time zone 'UTC' at time zone 'Asia/Tehran' as t from events))""")(
    lambda spark, sf: X.table(spark, sf, "events").select(
        "event_id", G.schedule_active(c("ts").cast("timestamp"), F.array(*map(F.lit, range(6))), F.lit(1320), F.lit(360), F.lit("Asia/Tehran")).alias("active")
    )
)
query("event_severity", with_sql("feed", body=""")
select event_id, case when kind like '%restricted_area_confirmed%' then 'critical' when kind like '%overflow%' then 'warning' else 'info' end as severity,
       case when kind like '%overflow%' then 'criticalMinutes' when kind like '%line_crossed%' then 'entries' end as metric_key from feed"""))(
    lambda spark, sf: X.analytics_events(spark, sf).select("event_id", G.event_severity(c("kind")).alias("severity"), G.event_metric_key(c("kind")).alias("metric_key"))
)


@query("parse_polygon", """
select s_suppkey as camera_id, case when s_suppkey % 3 = 2 then null else 3 end as points from supplier""")
def parse_polygon(spark, sf):
    key = c("s_suppkey")
    text = F.when(key % 3 == 0, "[[0.1,0.2],[0.3,0.4],[0.5,0.1]]").when(key % 3 == 1, '[{"x":0.1,"y":0.2},{"x":0.3,"y":0.4},{"x":1,"y":0}]').otherwise("[[0.1,0.2],[1.3,0.4],[0.5,0.1]]")
    polygon = G.parse_polygon(text)
    return X.table(spark, sf, "supplier").select(key.alias("camera_id"), F.when(polygon.isNotNull(), F.size(polygon)).alias("points"))


query("zone_key", """
select s_suppkey as camera_id, left('queue-' || regexp_replace(s_name, '[^\\p{L}\\p{N}_.-]', '-', 'g') || '-' || right('region' || s_suppkey, 6), 100) as zone_key from supplier""")(
    lambda spark, sf: X.table(spark, sf, "supplier").select(c("s_suppkey").alias("camera_id"), G.zone_key(F.lit("queue"), c("s_name"), F.concat(F.lit("region"), c("s_suppkey"))).alias("zone_key"))
)
query("percent_change", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 9 <> 0 then (l_quantity - l_partkey % 9) / (l_partkey % 9) end as change, case when l_orderkey % 7 <> 0 then l_quantity / (l_orderkey % 7) end as share,
       case when l_partkey % 9 <> 4 then round((l_quantity - (l_partkey % 9 - 4)) * 100 / (l_partkey % 9 - 4), 2) end as percent from lineitem""")(
    lambda spark, sf: X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.ratio(c("l_quantity") - c("l_partkey") % 9, c("l_partkey") % 9).alias("change"), G.ratio(c("l_quantity"), c("l_orderkey") % 7).alias("share"),
        G.percent_change(c("l_quantity"), c("l_partkey") % 9 - 4).alias("percent"),
    )
)
query("validate_polygons", with_sql("obs", body="), t as (select distinct track_id from obs) select track_id as zone_id, case track_id % 4 when 0 then 'crosses_itself' when 1 then 'too_few_points' else 'no_area' end as problem from t where track_id % 4 < 3"))(
    lambda spark, sf: D.validate_polygons(
        X.observations(spark, sf).select(c("track_id").alias("zone_id")).distinct().withColumn(
            "polygon",
            F.when(c("zone_id") % 4 == 0, G.literal_polygon([(0, 0), (3, 3), (0, 3), (1, 0)])).when(c("zone_id") % 4 == 1, G.literal_polygon([(0, 0), (1, 1)]))
            .when(c("zone_id") % 4 == 2, G.literal_polygon([(0, 0), (1, 0), (2, 0)])).otherwise(G.literal_polygon(X.WEDGE)),
        )
    )
)


@query("fit_homographies", with_sql("cams", body="""), m as (select camera_id, camera_id % 6 <> 5 as ok, round((camera_id % 5 + 1) / 10.0::double, 6) as k, (camera_id % 7)::double as dx, (camera_id % 3)::double as dy from cams)
select camera_id, case when not ok then 'fewer than four pairs' end as reason, case when ok then k end as xx, case when ok then 0.0::double end as xy, case when ok then dx end as x0,
       case when ok then 0.0::double end as yx, case when ok then k end as yy, case when ok then dy end as y0 from m"""))
def fit_homographies(spark, sf):
    """Scaled and shifted by camera; every sixth camera has three pairs only."""
    scale, corners = (c("camera_id") % 5 + 1) / 10, ((0, 0), (100, 0), (100, 100), (0, 100))
    pair = lambda x, y: F.struct(F.lit(float(x)).alias("ix"), F.lit(float(y)).alias("iy"), (x * scale + c("camera_id") % 7).alias("gx"), (y * scale + c("camera_id") % 3).alias("gy"))
    pairs = F.slice(F.array(*[pair(x, y) for x, y in corners]), F.lit(1), F.when(c("camera_id") % 6 == 5, 3).otherwise(4))
    fitted = D.fit_homographies(X.cameras(spark, sf).select("camera_id", F.explode(pairs).alias("p")).select("camera_id", "p.*"))
    part = lambda at, name: (F.round(c("homography")[at], 6) + F.lit(0.0)).alias(name)
    return fitted.select("camera_id", "reason", *[part(at, name) for at, name in enumerate(("xx", "xy", "x0", "yx", "yy", "y0"))])


query("check_ground_distance", with_sql("obs", body="), r as (select camera_id, track_id, frame_index, arrival, round(sqrt(px * px * 0.01::double + py * py * 0.01::double), 6) as measured from obs) select *, round(abs(measured - 5), 6) as absolute_error from r"))(
    lambda spark, sf: D.check_ground_distance(obs(spark, sf, F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), c("px").alias("bx"), c("py").alias("by"), F.lit(5.0).alias("known")), F.array(*map(F.lit, X.HOMOGRAPHY)))
    .select(*ID, F.round("measured", 6).alias("measured"), F.round("absolute_error", 6).alias("absolute_error"))
)

# Detections: each observed box and a copy of it, shifted and less sure.


def boxes(spark, sf):
    rows = X.observations(spark, sf)
    part = lambda k: rows.select("camera_id", "frame_index", (c("arrival") * 2 + k).alias("box_id"), (c("x1") + k * (c("arrival") % 5)).alias("x1"), "y1", (c("x2") + k * (c("arrival") % 5)).alias("x2"), "y2", (c("confidence") - 0.1 * k).alias("score"))
    return part(0).union(part(1)).withColumns({"class_id": F.lit(0), "class_name": F.when(c("box_id") % 3 == 0, "Person")})


BOXES = """), boxes as (
  select camera_id, frame_index, arrival * 2 + k as box_id, x1 + k * (arrival % 5) as x1, y1, x2 + k * (arrival % 5) as x2, y2, confidence - 0.1::double * k as score from obs, (values (0), (1)) t(k)
"""
query("decode_detections", with_sql("obs", body=") select camera_id, arrival, px - 6 / 2 as x1, (py - 6) - 12 / 2 as y1, px + 6 / 2 as x2, (py - 6) + 12 / 2 as y2 from obs where confidence >= 0.6::double"))(
    lambda spark, sf: D.decode_detections(
        X.observations(spark, sf).select("camera_id", "arrival", c("px").alias("cx"), (c("py") - 6).alias("cy"), F.lit(6.0).alias("w"), F.lit(12.0).alias("h"), c("confidence").alias("score")), 0.6
    ).drop("score")
)
query("restore_letterbox", with_sql("obs", body="""), r as (
  select arrival, greatest(0.0::double, least(50.0::double, (x1 - 10) / 2.0::double)) as x1, greatest(0.0::double, least(40.0::double, (y1 - 5) / 2.0::double)) as y1, greatest(0.0::double, least(50.0::double, (x2 - 10) / 2.0::double)) as x2, greatest(0.0::double, least(40.0::double, (y2 - 5) / 2.0::double)) as y2 from obs
) select * from r where x2 > x1 and y2 > y1"""))(lambda spark, sf: D.restore_letterbox(X.observations(spark, sf).select("arrival", "x1", "y1", "x2", "y2"), 2.0, 10.0, 5.0, 50, 40))
query("suppress_overlaps")(lambda spark, sf: D.suppress_overlaps(boxes(spark, sf).drop("class_id", "class_name"), 0.5))
query("person_filter", with_sql("obs", body=BOXES + ") select box_id from boxes where box_id % 7 <> 0 and box_id % 5 <> 0"))(
    lambda spark, sf: D.person_filter(
        boxes(spark, sf).withColumns({"class_id": F.when(c("box_id") % 7 == 0, 2).otherwise(0), "class_name": F.when(c("box_id") % 5 == 0, "dog").otherwise(c("class_name"))})
    ).select("box_id")
)
query("check_detections", with_sql("obs", body=BOXES + ") select box_id, case when x1 < -1 or y1 < -1 or x2 > 102 or y2 > 102 then 'outside_frame' end as problem from boxes"))(
    lambda spark, sf: D.check_detections(boxes(spark, sf), 101, 101).select("box_id", "problem")
)
query("stride_sample", with_sql("obs", body=") select camera_id, arrival from obs where frame_index % 5 = 0"))(lambda spark, sf: D.stride_sample(X.observations(spark, sf).withColumn("source_index", c("frame_index")), 5).select("camera_id", "arrival"))
query("slot_sample", with_sql("obs", "frames", body="), s as (select *, floor((ts - min(ts) over (partition by camera_id)) / 7)::bigint as slot from frames) select camera_id, frame_index, ts, slot from s qualify row_number() over (partition by camera_id, slot order by ts) = 1"))(
    lambda spark, sf: D.slot_sample(X.frames(X.observations(spark, sf)), 7.0)
)
query("dedupe_frame", with_sql("obs", "seen", body=") select camera_id, track_id, frame_index, arrival from seen"))(lambda spark, sf: people.dedupe_frame(X.observations(spark, sf)).select(*ID))
query("reject_out_of_order", with_sql("obs", body=") select camera_id, arrival, coalesce(ts >= max(ts) over (partition by camera_id order by arrival rows between unbounded preceding and 1 preceding), true) as valid from obs"))(
    lambda spark, sf: people.reject_out_of_order(X.observations(spark, sf)).select("camera_id", "arrival", "valid")
)

# Re-identification.


def vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", c("vec_id").alias("frame"), c("label").cast("long").alias("track_id"), c("embedding").alias("vector"))


query("normalize_embedding", "select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as first from embeddings")(
    lambda spark, sf: vectors(spark, sf).select("vec_id", F.round(motion.normalize_embedding(c("vector"))[0], 5).alias("first"))
)


def gallery(spark, sf):
    return motion.gallery_prototypes(vectors(spark, sf))


query("gallery_prototypes")(gallery)
query("gallery_match")(lambda spark, sf: motion.gallery_match(vectors(spark, sf).select(c("vec_id").alias("query_id"), "frame", "vector"), gallery(spark, sf), 0.1, 1_000_000_000))

# Minute compaction: a frame of the fixture stands for ten seconds.

AT = "timestamp '2024-01-01 00:00:00' + to_seconds(frame_index * 10)"


def frame_rows(spark, sf):
    o = X.observations(spark, sf)
    rows = people.people_per_frame(o, X.frames(o))
    return rows.select("camera_id", F.timestamp_seconds(F.lit(1_704_067_200) + c("frame_index") * 10).alias("at"), c("current_people").alias("people"), c("unique_people").alias("entries"), (c("unique_people") / 2).cast("long").alias("exits"))


FRAME_ROWS = f"""), first as (select camera_id, track_id, min(frame_index) as f from seen group by 1, 2
), fr as (
  select f.camera_id, {AT} as at_, (select count(*) from seen s where s.camera_id = f.camera_id and s.frame_index = f.frame_index) as people,
         (select count(*) from first a where a.camera_id = f.camera_id and a.f <= f.frame_index) as entries from frames f
"""
query("camera_minutes", with_sql("obs", "frames", "seen", body=FRAME_ROWS + """)
select camera_id, date_trunc('minute', at_) as bucket_start, count(*) as sample_count, 30 as expected_samples, count(*) as confidence_sum, sum(people)::bigint as occupancy_sum, max(people) as occupancy_max, arg_max(people, at_) as occupancy_last,
       greatest(max(entries) - min(entries), 0) as entries, greatest(max(entries // 2) - min(entries // 2), 0) as exits from fr group by 1, 2"""))(lambda spark, sf: M.camera_minutes(frame_rows(spark, sf)))


def queue_frames(spark, sf):
    rows = frame_rows(spark, sf)
    return rows.select("camera_id", F.lit("q").alias("queue_id"), "at", c("people").alias("length"), (c("people") * 100).cast("double").alias("wait"), F.when(c("people") > 2, 0.5).alias("speed_m"), c("exits").alias("completed"), (c("exits") * 10).cast("double").alias("last_wait"))


query("queue_minutes", with_sql("obs", "frames", "seen", body=FRAME_ROWS + """), q as (
  select *, date_trunc('minute', at_) as bucket_start, entries // 2 as done, people * 100.0::double as wait from fr
), w as (select *, done > lag(done, 1, 0) over (partition by camera_id, bucket_start order by at_) as new_ from q)
select camera_id, 'q' as queue_id, bucket_start, count(*) as sample_count, sum(people)::bigint as length_sum, max(people) as length_max, arg_max(people, at_) as length_last, sum(wait) as wait_sum_seconds, count(*) as wait_sample_count,
       max(done) - min(done) as throughput, count(*) filter (wait >= 300) as warning_samples, count(*) filter (wait >= 600) as critical_samples, 30.0::double * count(*) filter (people > 2) as movement_speed_sum_mpm, count(*) filter (people > 2) as movement_speed_samples,
       count(*) filter (people > 2) > 0 as physically_calibrated, count(*) filter (new_) as n_waits, count(*) filter (new_ and done * 10 <= 300) as sla_met from w group by 1, 2, 3"""))(
    lambda spark, sf: M.queue_minutes(queue_frames(spark, sf)).withColumn("n_waits", F.size("completed_waits")).drop("completed_waits")
)
query("minute_events", with_sql("feed", body="), r as (select camera_id, event_id, date_trunc('minute', occurred_at) as bucket_start from feed) select * from r qualify row_number() over (partition by camera_id, bucket_start order by event_id desc) <= 500"))(
    lambda spark, sf: M.minute_events(X.analytics_events(spark, sf)).select("camera_id", "event_id", "bucket_start")
)


def layers(spark, sf):
    """Two points for each write of a camera-minute and layer, within its minute."""
    m = X.minutes(spark, sf)
    point = lambda x, y, v: F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"), c(v).cast("double").alias("value"), F.lit(0.5).alias("intensity"))
    return m.select("camera_id", "layer", F.array(point("xa", "ya", "sample_count"), point("xb", "yb", "arrival")).alias("points"), (c("bucket_start") + F.make_interval(secs=c("sample_count"))).alias("at"), "arrival")


def crowded(spark, sf):
    """Every third write also has two crowded regions, half of them at the time of a layer, the others between seconds."""
    m = X.minutes(spark, sf).where("arrival % 3 = 0")
    region = lambda v, a, b: F.struct(v.cast("double").alias("average"), F.lit(a).alias("x1"), F.lit(0.0).alias("y1"), F.lit(b).alias("x2"), F.lit(0.5).alias("y2"))
    regions = F.array(region(c("occupancy_max"), 0.0, 0.25), region(c("entries"), 0.25, 0.5))
    at = c("bucket_start") + F.make_interval(secs=c("sample_count") + F.when(c("arrival") % 2 == 0, 0.0).otherwise(0.5))
    return m.groupBy("camera_id", at.alias("at")).agg(F.max_by(regions, "arrival").alias("regions"))


def last_layers(spark, sf):
    """One write of each camera, layer and time: the latest."""
    return layers(spark, sf).groupBy("camera_id", "layer", "at").agg(F.max_by("points", "arrival").alias("points"))


SPATIAL = """), list as (
  select camera_id, bucket_start, layer, bucket_start + to_seconds(sample_count) as at_, [[xa::double, ya::double, sample_count::double, 0.5::double], [xb::double, yb::double, arrival::double, 0.5::double]] as points, arrival, 1 as own from minutes
  union all
  select camera_id, bucket_start, 'congestion', bucket_start + to_seconds(sample_count) + case when arrival % 2 = 0 then interval 0 second else interval 500 millisecond end,
         [[12.5::double, 25.0::double, occupancy_max::double, occupancy_max::double / greatest(occupancy_max, entries)], [37.5::double, 25.0::double, entries::double, entries::double / greatest(occupancy_max, entries)]], arrival, 0
  from minutes where arrival % 3 = 0
), spatial as (
  select * from list qualify row_number() over (partition by camera_id, bucket_start, layer order by at_ desc, own desc, arrival desc) = 1
)"""
FLAT = "array_to_string(list_transform(points, lambda p: array_to_string(list_transform(p, lambda v: (round_even(v * 1000, 0)::hugeint)::varchar), '/')), ' ')"


def whole(v):
    """A whole double as text with all its digits: a cast to decimal has the 17 of the double's text, the others 0."""
    high = F.floor(v / 2.0**62)
    low = (v - high.cast("double") * 2.0**62).cast("long")
    digits = high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.when(F.abs(v) < 2.0**62, v.cast("long").cast("string")).otherwise(digits.cast("decimal(38,0)").cast("string"))


def flat(points):
    """The points as text, in thousandths."""
    number = lambda v: whole(F.rint(v * 1000))
    return F.array_join(F.transform(points, lambda p: F.concat_ws("/", *[number(p[k]) for k in ("x", "y", "value", "intensity")])), " ")


def spatial_lists(spark, sf):
    return M.minute_spatial(last_layers(spark, sf), regions=crowded(spark, sf))


query("minute_spatial", with_sql("minutes", body=SPATIAL + f" select camera_id, bucket_start, layer, {FLAT} as points from spatial"))(
    lambda spark, sf: spatial_lists(spark, sf).withColumn("points", flat(c("points")))
)


@query("minute_documents", with_sql("obs", "frames", "seen", "minutes", "feed", body=FRAME_ROWS + """), m as (
  select camera_id, date_trunc('minute', at_) as bucket_start, count(*) as n, sum(people)::bigint as people, max(entries) - min(entries) as entries from fr group by 1, 2
), q as (
  select *, done > lag(done, 1, 0) over (partition by camera_id, date_trunc('minute', at_) order by at_) as new_ from (select *, entries // 2 as done from fr)
), qn as (select camera_id, date_trunc('minute', at_) as bucket_start, 'q:' || count(*) || ':' || sum(people)::bigint || ':' || count(*) filter (new_) as queues from q group by 1, 2
), e as (
  select camera_id, date_trunc('minute', occurred_at) as bucket_start, string_agg(event_id::varchar, ',' order by event_id) as events from feed group by 1, 2
""" + SPATIAL.replace("spatial as (", "chosen as (") + f""", s as (select camera_id, bucket_start, string_agg(layer || '=' || {FLAT}, ';' order by layer) as spatial from chosen group by 1, 2)
select m.*, queues, events, spatial from m left join qn using (camera_id, bucket_start) left join e using (camera_id, bucket_start) left join s using (camera_id, bucket_start)"""))
def minute_documents(spark, sf):
    """Camera-minutes with what is nested in them as text, in order."""
    events = M.minute_events(X.analytics_events(spark, sf)).select("camera_id", "bucket_start", "event_id")
    rows = M.minute_documents(M.camera_minutes(frame_rows(spark, sf)), M.queue_minutes(queue_frames(spark, sf)), events, spatial_lists(spark, sf))
    queues = F.array_join(F.transform("queues", lambda q: F.concat_ws(":", q["queue_id"], q["sample_count"].cast("string"), q["length_sum"].cast("string"), F.size(q["completed_waits"]).cast("string"))), ",")
    told = F.array_join(F.transform("spatial", lambda x: F.concat_ws("=", x["layer"], flat(x["points"]))), ";")
    listed = F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",")
    return rows.select("camera_id", "bucket_start", c("sample_count").alias("n"), c("occupancy_sum").alias("people"), "entries", queues.alias("queues"), listed.alias("events"), told.alias("spatial"))


# Bundles: camera-minutes as JSON lines, some of them broken on purpose.


def documents(spark, sf):
    """line and arrival; the given table is one row group, so its rows are dealt out before they become documents."""
    m = X.minutes(spark, sf).repartition(spark.sparkContext.defaultParallelism, "arrival")  # by key: no sort, as dealing in turns needs
    start = F.concat(F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("arrival") % 7 == 0, "").otherwise("Z"))
    queue = F.struct(c("queue_id").alias("queueId"), c("queue_id").alias("queueName"), c("sample_count").alias("sampleCount"), c("occupancy_sum").cast("double").alias("lengthSum"), F.array(c("wait_seconds").cast("double")).alias("completedWaitSeconds"))
    point = F.struct(c("xa").cast("double").alias("x"), (c("ya") + F.when(c("arrival") % 11 == 0, 100).otherwise(0)).cast("double").alias("y"), c("sample_count").cast("double").alias("value"), F.lit(0.5).alias("intensity"))
    doc = F.struct(
        c("camera_id").cast("string").alias("cameraId"), start.alias("bucketStart"), F.when(c("arrival") % 5 == 0, -1).otherwise(c("sample_count")).alias("sampleCount"), c("expected_samples").alias("expectedSamples"),
        c("entries"), c("exits"), F.array(queue).alias("queues"), F.array(F.struct(c("layer"), F.array(point).alias("points"))).alias("spatial"),
    )
    return m.select(F.to_json(doc).alias("line"), "arrival")


def lines(spark, sf):
    return io.parsed(documents(spark, sf).select("line"))


BAD = "(arrival % 7 = 0)::int as a, (arrival % 5 = 0)::int as b, (arrival % 11 = 0 and ya + 100 > 100)::int as c"
query("validate_minutes", with_sql("minutes", body=f"), r as (select {BAD} from minutes) select case when a + b + c = 0 then 'valid' else array_to_string(list_filter([case when a = 1 then 'bucket_start' end, case when b = 1 then 'sample_count' end, case when c = 1 then 'point' end], lambda x: x is not null), ',') end as reasons, count(*) as n from r group by 1"))(
    lambda spark, sf: io.marked(lines(spark, sf)).groupBy(F.when(F.size("reasons") == 0, "valid").otherwise(F.array_join("reasons", ",")).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))
)
query("explode_minutes", with_sql("minutes", body=f"), r as (select *, {BAD} from minutes), g as (select * from r where a + b + c = 0) select 'queue' as kind, queue_id as name, count(*) as n, sum(sample_count)::bigint as total from g group by 2 union all select 'wait', queue_id, count(*), sum(wait_seconds)::bigint from g group by 2 union all select 'spatial', layer, count(*), count(*) from g group by 2"))(
    lambda spark, sf: io.minute_parts(io.validate_minutes(lines(spark, sf))[0]).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"))
)
query("bundle_summary", with_sql("minutes", "minute", "queue_minute", body=""")
select count(*) as records, sum(entries)::bigint as entries, sum(exits)::bigint as exits, max(occupancy_max) as peak_occupancy, sum(occupancy_sum)::double / sum(sample_count) as average_occupancy, sum(sample_count) * 100.0::double / sum(expected_samples) as coverage_percent,
  (select sum(wait_seconds * sample_count)::double / sum(sample_count) / 60 from queue_minute) as average_wait_minutes, (select sum((wait_seconds <= 300)::int) * 100.0::double / count(*) from queue_minute) as sla_percent from minute"""))(
    lambda spark, sf: io.bundle_summary(management.minutes(spark, sf), management.queue_minutes(spark, sf))
)


@query("reconcile_bundle", "select 'records' as key, true as passed union all select 'peak_occupancy', false")
def reconcile_bundle(spark, sf):
    minutes = management.minutes(spark, sf)
    summary = io.bundle_summary(minutes, management.queue_minutes(spark, sf))
    expected = minutes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("occupancy_max").cast("double").alias("p"))
    expected = expected.select(F.inline(F.array(F.struct(F.lit("records").alias("key"), c("n").alias("expected")), F.struct(F.lit("peak_occupancy").alias("key"), (c("p") + 1).alias("expected")))))
    return io.reconcile(summary, expected).select("key", "passed")


query("frame_table", with_sql("obs", "frames", "seen", body="), h as (select camera_id, frame_index, count(*) filter (px between 20 and 80 and py between 20 and 80) as a, count(*) filter (px >= 10 and py between 10 and 90 and px <= case when py <= 50 then 100 - py else py end) as b from seen group by 1, 2) select camera_id, frame_index, coalesce(a, 0) as occupancy_floor, case when camera_id % 2 = 0 then coalesce(b, 0) end as occupancy_wedge from frames left join h using (camera_id, frame_index)"))(
    lambda spark, sf: (lambda o: io.frame_table(people.zone_occupancy(o, X.frames(o), X.zones(o)), ["floor", "wedge"]))(X.observations(spark, sf))
)

# Evaluation: tracker B loses every sixth box, shifts the others and changes ids at frame 60.


def truth(spark, sf):
    return people.dedupe_frame(X.observations(spark, sf)).select("camera_id", "frame_index", "track_id", "x1", "y1", "x2", "y2", "arrival")


def found(spark, sf):
    rows = truth(spark, sf).where("arrival % 6 <> 0")
    shift = c("arrival") % 7
    return rows.select("camera_id", "frame_index", (c("track_id") + F.when(c("frame_index") > 60, 5000).otherwise(1000)).alias("track_id"), (c("x1") + shift).alias("x1"), "y1", (c("x2") + shift).alias("x2"), "y2")


def matched(spark, sf):
    return D.match_frames(D.candidate_pairs(truth(spark, sf), found(spark, sf), 0.5), 0.5)


query("match_frames")(matched)
query("clear_metrics")(lambda spark, sf: D.clear_metrics(truth(spark, sf), found(spark, sf), settled(matched(spark, sf))))
query("id_switches")(lambda spark, sf: D.id_switches(matched(spark, sf)))
query("fragmentation")(lambda spark, sf: D.fragmentation(truth(spark, sf), matched(spark, sf)))
query("idf1")(lambda spark, sf: D.idf1(truth(spark, sf), found(spark, sf), matched(spark, sf)))
query("hota")(lambda spark, sf: D.hota(settled(truth(spark, sf)), settled(found(spark, sf))))


@query("compare_trackers")
def compare_trackers(spark, sf):
    """CLEAR, identity and HOTA measures of two trackers side by side."""
    t = truth(spark, sf)
    return D.compare_trackers(t, {"a": t.drop("arrival").withColumn("track_id", c("track_id") + 1000), "b": found(spark, sf)})
