"""Queries over camera-minute facts, rollups and read models, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import facts, reports
from flowlake.plans import fixtures as X
from flowlake.plans.fixtures import with_sql

QUERIES, ORACLES = {}, {}
NOW = "2024-01-10 12:00:00"
WEEK = reports.Query(start="2024-01-07 20:30:00", end="2024-01-14 20:30:00", comparison="previous_week")
DAY = reports.Query(start="2024-01-07 20:30:00", end="2024-01-14 20:30:00", bucket="day", time_from="08:00", time_to="20:00")
FIELD = reports.Query(start="2024-01-07 20:30:00", end="2024-01-14 20:30:00", location_type="field", location_id="1")
A = "bucket_start >= timestamp '2024-01-07 20:30:00' and bucket_start < timestamp '2024-01-14 20:30:00'"
B = "bucket_start >= timestamp '2023-12-31 20:30:00' and bucket_start < timestamp '2024-01-07 20:30:00'"
RECENT = "bucket_start between timestamp '2024-01-10 11:50:00' and timestamp '2024-01-10 12:00:00'"
LOCAL = "bucket_start at time zone 'UTC' at time zone 'Asia/Tehran'"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles come in any order; six decimals are the same in all."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def minutes(spark, sf):
    """Keys have bucket_start beside the minute's number, which it follows from, so that a period is cut before the last writes are sought."""
    return facts.upsert_last(X.minutes(spark, sf), ["camera_id", "minute_index", "bucket_start"])


def queue_minutes(spark, sf):
    c = F.col
    rows = facts.upsert_last(X.minutes(spark, sf), ["camera_id", "queue_id", "minute_index", "bucket_start"])
    calibrated = c("camera_id") % 4 != 0
    speed = F.when(calibrated, 4 * c("sample_count")).otherwise(F.lit(0))
    return rows.select(
        "camera_id", "queue_id", "bucket_start", "sample_count", c("occupancy_sum").alias("length_sum"), c("occupancy_max").alias("length_max"), c("occupancy_last").alias("length_last"),
        (c("wait_seconds") * c("sample_count")).alias("wait_sum_seconds"), c("sample_count").alias("wait_sample_count"), F.lit(1).cast("long").alias("throughput"),
        (c("wait_seconds") <= 300).cast("long").alias("sla_met"), F.when(c("wait_seconds") >= 300, c("sample_count")).otherwise(0).alias("warning_samples"),
        F.when(c("wait_seconds") >= 600, c("sample_count")).otherwise(0).alias("critical_samples"), speed.alias("movement_speed_sum_mpm"),
        F.when(calibrated, c("sample_count")).otherwise(0).alias("movement_speed_samples"), calibrated.alias("physically_calibrated"), "wait_seconds",
    )


def sources(spark, sf):
    return facts.camera_sources(X.cameras(spark, sf))


def hours(spark, sf):
    return facts.location_hours(minutes(spark, sf), X.cameras(spark, sf))


def queue_hours(spark, sf):
    return facts.queue_location_hours(queue_minutes(spark, sf), X.cameras(spark, sf))


def of(spark, sf, q, rows, level, other=False):
    """The rollups of a level in the question's scope and period."""
    scoped = reports.scope_rollups(rows, X.cameras(spark, sf), level, q)
    return reports.in_period(scoped, "bucket_start", reports.compared(q) if other else reports.bounds(q), q)


def flow(spark, sf, q=WEEK, other=False):
    return of(spark, sf, q, hours(spark, sf), q.overall(), other)


def queues(spark, sf, q=WEEK, other=False):
    return of(spark, sf, q, queue_hours(spark, sf), q.overall(), other)


def spatial(spark, sf):
    c = F.col
    place = lambda x, y, v: F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"), v.cast("double").alias("value"))
    rows = X.minutes(spark, sf).select(
        "camera_id", "bucket_start", c("queue_id").alias("zone_id"), "layer", F.array(place("xa", "ya", c("sample_count")), place("xb", "yb", 2 * c("sample_count"))).alias("points"),
        (c("sample_count") * 2).cast("double").alias("coverage_percent"), "arrival",
    )
    rows = facts.upsert_last(rows, ["camera_id", "zone_id", "layer", "bucket_start"])
    return reports.spatial_rows(rows, sources(spark, sf))


HOURS = """
), hourly as (
  select camera_id, date_trunc('hour', bucket_start) as bucket_start, sum(occupancy_sum)::double / sum(sample_count) as average, max(occupancy_max) as peak,
         sum(sample_count) as sample_count, sum(expected_samples) as expected_samples, sum(entries) as entries, sum(exits) as exits
  from minute group by 1, 2
), place as (
  select camera_id, enabled, calibrated, location_type, case location_type when 'field' then field_id when 'market' then market_id else booth_id end as location_id
  from cams, (values ('field'), ('market'), ('booth')) l(location_type)
), expect as (
  select location_type, location_id, count(*) as expected_sources from place where enabled and location_id is not null group by 1, 2
), hours as (
  select p.location_type, p.location_id, bucket_start, sum(average) as occupancy_sum, sum(peak)::bigint as occupancy_max, sum(sample_count)::bigint as sample_count, sum(expected_samples)::bigint as expected_samples,
         sum(sample_count)::bigint as confidence_sum, sum(entries)::bigint as entries, sum(exits)::bigint as exits, count(*) filter (sample_count > 0) as contributing_sources,
         coalesce(max(expected_sources), 0) as expected_sources, case when coalesce(max(expected_sources), 0) = 1 then sum(entries)::bigint end as unique_visitors
  from hourly h join place p on h.camera_id = p.camera_id and location_id is not null
  left join expect e on e.location_type = p.location_type and e.location_id = p.location_id group by 1, 2, 3
"""
QROWS = """
), qm as (
  select camera_id, queue_id, bucket_start, sample_count, occupancy_sum as length_sum, occupancy_max as length_max, occupancy_last as length_last, wait_seconds * sample_count as wait_sum_seconds, sample_count as wait_sample_count,
         1 as throughput, (wait_seconds <= 300)::int as sla_met, case when wait_seconds >= 300 then sample_count else 0 end as warning_samples, case when wait_seconds >= 600 then sample_count else 0 end as critical_samples,
         case when camera_id % 4 <> 0 then 4 * sample_count else 0 end as movement_speed_sum_mpm, case when camera_id % 4 <> 0 then sample_count else 0 end as movement_speed_samples, camera_id % 4 <> 0 as physically_calibrated, wait_seconds
  from queue_minute
"""
QHOURS = QROWS + """), place as (
  select camera_id, location_type, case location_type when 'field' then field_id when 'market' then market_id else booth_id end as location_id from cams, (values ('field'), ('market'), ('booth')) l(location_type)
), qhours as (
  select location_type, location_id, queue_id, date_trunc('hour', bucket_start) as bucket_start, """ + ", ".join(f"sum({c})::bigint as {c}" for c in facts.QUEUE_SUMS) + """,
         max(length_max) as length_max, count(distinct case when physically_calibrated then q.camera_id end) as calibrated_sources
  from qm q join place p on q.camera_id = p.camera_id where location_id is not null group by 1, 2, 3, 4
"""
BOTH_HOURS = HOURS + ")" + QHOURS.strip().removeprefix(")").replace("), place as (", "), qplace as (").replace("join place p", "join qplace p") + ")"
MEASURES = """sum(sample_count)::bigint as sample_count, sum(length_sum)::double / nullif(sum(sample_count), 0) as average_length, max(length_max) as maximum_length,
  sum(wait_sum_seconds)::double / nullif(sum(wait_sample_count), 0) as average_wait, sum(throughput)::bigint as throughput, sum(sla_met)::bigint as sla_met, sum(warning_samples)::bigint as warning_samples,
  sum(critical_samples)::bigint as critical_samples, sum(movement_speed_sum_mpm)::double / nullif(sum(movement_speed_samples), 0) as movement_speed"""
SRC = """, src as (
  select *, coalesce(booth_id, market_id, field_id) as location_id, case when booth_id is not null then 'booth' when market_id is not null then 'market' else 'field' end as location_type from cams
)"""
SPATIAL = SRC + """, sp as (
  select m.camera_id, m.bucket_start, queue_id as zone_id, layer, [{'x': xa, 'y': ya, 'value': sample_count::double}, {'x': xb, 'y': yb, 'value': 2.0::double * sample_count}] as points, sample_count * 2.0::double as coverage_percent, s.location_id, s.location_type
  from (select * from minutes qualify row_number() over (partition by camera_id, queue_id, layer, bucket_start order by arrival desc) = 1) m join src s on m.camera_id = s.camera_id where enabled
), pt as (select sp.* exclude (points), unnest(points) as p from sp)"""


def merged_sql(where: str) -> str:
    return f"select p.x::int as x, p.y::int as y, avg(p.value) as value from pt where layer = 'occupancy' and {where} group by 1, 2"


def h(body: str) -> str:
    return with_sql("minutes", "minute", "cams", body=HOURS + "), " + body)


def qh(body: str) -> str:
    return with_sql("minutes", "queue_minute", "cams", body=QHOURS + "), " + body)


query("upsert_minutes", with_sql("minutes", "minute", body=") select camera_id, minute_index, arrival, sample_count, entries from minute"))(
    lambda spark, sf: minutes(spark, sf).select("camera_id", "minute_index", "arrival", "sample_count", "entries")
)


@query("insert_ignore_waits", with_sql("minutes", body="""
), old as (select * from minutes where minute_index < 5000 qualify row_number() over (partition by camera_id, queue_id, minute_index order by arrival) = 1
), fresh as (select * from minutes where minute_index < 8000 qualify row_number() over (partition by camera_id, queue_id, minute_index order by arrival) = 1)
select camera_id, queue_id, minute_index, wait_seconds from fresh n where not exists (select 1 from old o where o.camera_id = n.camera_id and o.queue_id = n.queue_id and o.minute_index = n.minute_index)"""))
def insert_ignore_waits(spark, sf):
    rows, key = X.minutes(spark, sf), ["camera_id", "queue_id", "minute_index"]
    old = facts.insert_ignore(rows.where("minute_index < 5000"), None, key)
    return facts.insert_ignore(rows.where("minute_index < 8000"), old, key).select(*key, "wait_seconds")


query("wait_events", with_sql("minutes", "queue_minute", body=""")
select sha256(camera_id || ':' || queue_id || ':' || strftime(bucket_start, '%Y-%m-%dT%H:%M:%S') || '+00:00:0:' || wait_seconds::double::varchar) as event_id, camera_id, queue_id, bucket_start as occurred_at, wait_seconds, wait_seconds <= 300 as sla_met from queue_minute"""))(
    lambda spark, sf: facts.wait_events(queue_minutes(spark, sf).withColumn("completed_waits", F.array("wait_seconds")))
)


@query("merge_camera_sources", with_sql("cams", body=""")
select camera_id, case when camera_id % 3 = 0 then 'new ' || camera_id when camera_id % 2 = 0 then 'name ' || camera_id end as name, calibrated and (camera_id % 2 = 0 or camera_id % 3 = 0) as calibrated from cams where camera_id % 2 = 0 or camera_id % 3 = 0"""))
def merge_camera_sources(spark, sf):
    cams, name = X.cameras(spark, sf), lambda t: F.concat(F.lit(t), F.col("camera_id")).alias("name")
    old = cams.where("camera_id % 2 = 0").select("camera_id", name("name "), "calibrated")
    return facts.merge_camera_sources(old, cams.where("camera_id % 3 = 0").select("camera_id", name("new "), "calibrated"))


query("purge_expired", with_sql("minutes", body=") select camera_id, minute_index, arrival from minutes where bucket_start >= timestamp '2024-01-05 12:00:00'"))(
    lambda spark, sf: facts.purge_expired(X.minutes(spark, sf), "bucket_start", NOW, 5).select("camera_id", "minute_index", "arrival")
)
query("exclude_dataset", with_sql("cams", body=") select camera_id, name from cams where name not like '%1'"))(
    lambda spark, sf: facts.exclude_dataset(X.cameras(spark, sf).withColumn("tag", F.when(F.col("name").endswith("1"), "synthetic:1").otherwise("real")), "tag").select("camera_id", "name")
)


@query("catalog_diff", with_sql("cams", body=""")
select camera_id, case when camera_id % 7 = 0 then 'added' when camera_id % 5 = 0 then 'removed' when camera_id % 3 = 0 then 'changed' else 'same' end as state from cams where not (camera_id % 7 = 0 and camera_id % 5 = 0)"""))
def catalog_diff(spark, sf):
    cams = X.cameras(spark, sf).select("camera_id", F.col("market_id").alias("signature"))
    new = cams.where("camera_id % 5 <> 0").withColumn("signature", F.when(F.col("camera_id") % 3 == 0, F.lit("x")).otherwise(F.col("signature")))
    return facts.catalog_diff(cams.where("camera_id % 7 <> 0"), new)


@query("assemble_catalog", with_sql("cams", body=""")
select camera_id, name, 'rtsp://host/' || camera_id as url, (camera_id % 2 = 0)::int as n_queues, (camera_id % 3 = 0)::int as n_restricted from cams where camera_id % 4 <> 3 order by camera_id limit 500"""))
def assemble_catalog(spark, sf):
    cams = X.cameras(spark, sf)
    url = F.concat(F.when(F.col("camera_id") % 4 == 3, "http").otherwise("rtsp"), F.lit("://host/"), F.col("camera_id"))
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in X.SQUARE])
    region = lambda k, kind: cams.where(f"camera_id % {k} = 0").select("camera_id", F.lit(kind).alias("region_id"), F.lit(kind).alias("kind"), square.alias("polygon"))
    rows = facts.assemble_catalog(cams.select("camera_id", "name", url.alias("url")), region(2, "QUEUE").union(region(3, "RESTRICTED_AREA")), 500)
    return rows.select("camera_id", "name", "url", F.size("queues").alias("n_queues"), F.size("restricted").alias("n_restricted"))


query("camera_sources", with_sql("cams", body=") select *, coalesce(booth_id, market_id, field_id) as location_id, case when booth_id is not null then 'booth' when market_id is not null then 'market' else 'field' end as location_type from cams"))(sources)
query("location_hours", h("r as (select * replace (round(occupancy_sum, 6) as occupancy_sum) from hours) select * from r"))(lambda spark, sf: rounded(hours(spark, sf), "occupancy_sum"))
query("queue_location_hours", qh("r as (select * from qhours) select * from r"))(queue_hours)
query("refresh_rollups", with_sql("minutes", "minute", "cams", body=HOURS.replace("from minute group", "from minute where bucket_start >= timestamp '2024-01-10 09:00:00' and bucket_start < timestamp '2024-01-10 13:00:00' group") + ") select * replace (round(occupancy_sum, 6) as occupancy_sum) from hours"))(
    lambda spark, sf: rounded(facts.refresh_hours(minutes(spark, sf), X.cameras(spark, sf), NOW), "occupancy_sum")
)
query("expected_sources", with_sql("cams", body=") select count(*) as expected from cams where enabled and field_id = '1'"))(lambda spark, sf: reports.expected_sources(X.cameras(spark, sf), FIELD))


def summary_sql(where: str) -> str:
    return f"""
  select sum(sample_count)::bigint as sample_count, sum(expected_samples)::bigint as expected_samples, sum(confidence_sum)::bigint as confidence_sum, max(c)::bigint as contributing_sources, round(avg(o), 6) as average_occupancy,
         max(p)::bigint as peak_occupancy, sum(entries)::bigint as entries, sum(exits)::bigint as exits, case when max(e) = 1 then max(u) end as unique_visitors
  from (select bucket_start, sum(occupancy_sum) as o, sum(occupancy_max) as p, sum(contributing_sources) as c, sum(sample_count) as sample_count, sum(expected_samples) as expected_samples, sum(confidence_sum) as confidence_sum,
               sum(entries) as entries, sum(exits) as exits, max(expected_sources) as e, max(unique_visitors) as u from hours where {where} group by 1)"""


def trend_sql(where: str, bucket: str = "hour") -> str:
    return f"""select date_trunc('{bucket}', bucket_start) as timestamp, {"avg" if bucket == "day" else "sum"}(o) as occupancy, sum(i)::bigint as entries, sum(x)::bigint as exits
  from (select bucket_start, sum(occupancy_sum) as o, sum(entries) as i, sum(exits) as x from hours where {where} group by 1) group by 1"""


FA, FB = f"location_type = 'field' and {A}", f"location_type = 'field' and {B}"
HOURED = f"{FA} and strftime({LOCAL}, '%H:%M:%S') between '08:00:00' and '20:00:00'"

query("flow_summary", h(f"r as ({summary_sql(FA)}) select * from r"))(lambda spark, sf: rounded(reports.flow_summary(flow(spark, sf)), "average_occupancy"))
query("flow_trend", h(f"r as ({trend_sql(HOURED, 'day')}) select * replace (round(occupancy, 6) as occupancy) from r"))(lambda spark, sf: rounded(reports.flow_trend(flow(spark, sf, DAY), "day"), "occupancy"))
query("align_trend", h(f"a as (select *, row_number() over (order by timestamp) as k from ({trend_sql(FA)})), b as (select *, row_number() over (order by timestamp) as k from ({trend_sql(FB)})) select a.timestamp, round(a.occupancy, 6) as occupancy, a.entries, a.exits, round(b.occupancy, 6) as previous_occupancy from a left join b on a.k = b.k"))(
    lambda spark, sf: rounded(reports.align_trend(reports.flow_trend(flow(spark, sf), "hour"), reports.flow_trend(flow(spark, sf, WEEK, True), "hour"), "occupancy"), "occupancy", "previous_occupancy")
)
query("tag_periods", h(f"r as (select 'A' as period, * from hours where {FA} union all select 'B', * from hours where {FB}) select period, count(*) as n, sum(entries)::bigint as entries from r group by 1"))(
    lambda spark, sf: reports.tag_periods(reports.scope_rollups(hours(spark, sf), X.cameras(spark, sf), "field", WEEK), "bucket_start", WEEK).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))
)
query("scope_rollups", h("r as (select * from hours where location_type = 'booth' and location_id in (select booth_id from cams where field_id = '1')) select location_id, bucket_start, entries from r"))(
    lambda spark, sf: reports.scope_rollups(hours(spark, sf), X.cameras(spark, sf), "booth", FIELD).select("location_id", "bucket_start", "entries")
)
query("scope_cameras", with_sql("cams", body=") select camera_id from cams where field_id = '1'"))(lambda spark, sf: reports.scope_cameras(X.cameras(spark, sf), FIELD).select("camera_id"))
query("latest_occupancy", with_sql("minutes", "minute", "cams", body=f"""
), l as (select m.camera_id, arg_max(occupancy_last, bucket_start) as v from minute m join cams c on m.camera_id = c.camera_id where enabled and {RECENT} group by 1) select sum(v)::bigint as value from l"""))(
    lambda spark, sf: reports.latest(minutes(spark, sf).join(X.cameras(spark, sf).where("enabled").select("camera_id"), "camera_id", "left_semi"), ["camera_id"], "occupancy_last", NOW).agg(F.sum("value").alias("value"))
)
LOCATIONS = f"""select location_id, avg(occupancy_sum) as value, max(occupancy_max) as peak, sum(entries)::bigint as entries, sum(exits)::bigint as exits, least(100.0::double, sum(sample_count)::double * 100 / nullif(sum(expected_samples), 0)) as coverage
  from hours where location_type = 'market' and location_id in (select market_id from cams where field_id = '1') and {A} group by 1 order by value desc nulls last, location_id limit 500"""


def flow_locations(spark, sf):
    return reports.flow_locations(of(spark, sf, FIELD, hours(spark, sf), FIELD.target()))


query("flow_locations", h(f"r as ({LOCATIONS}) select * replace (round(value, 6) as value) from r"))(lambda spark, sf: rounded(flow_locations(spark, sf), "value"))
query("peak_periods", h(f"r as ({trend_sql(FA)} order by occupancy desc, timestamp limit 8) select timestamp as \"from\", timestamp + interval 1 hour as \"to\", round(occupancy, 6) as value from r"))(
    lambda spark, sf: rounded(reports.peak_periods(reports.flow_trend(flow(spark, sf), "hour"), "hour"), "value")
)
query("activity_heatmap", h(f"r as (select bucket_start, sum(occupancy_sum) as v from hours where {FA} group by 1) select ((dayofweek({LOCAL}) + 1) % 7)::int as day, hour({LOCAL})::int as hour, round(avg(v), 6) as value from r group by 1, 2"))(
    lambda spark, sf: rounded(reports.activity_heatmap(flow(spark, sf), WEEK.zone), "value")
)
query("queue_summary", qh(f"r as (select {MEASURES}, max(calibrated_sources) as calibrated_sources from qhours where {FA}) select * from r"))(lambda spark, sf: reports.queue_measures(queues(spark, sf)))
query("queue_trend", qh(f"r as (select date_trunc('hour', bucket_start) as timestamp, {MEASURES} from qhours where {FA} group by 1) select timestamp, average_length, average_wait, throughput, sla_met from r"))(
    lambda spark, sf: reports.queue_trend(queues(spark, sf), "hour")
)
query("latest_queue_length", with_sql("minutes", "queue_minute", "cams", body=f"""
), l as (select m.camera_id, queue_id, arg_max(occupancy_last, bucket_start) as v from queue_minute m join cams c on m.camera_id = c.camera_id where enabled and {RECENT} group by 1, 2) select sum(v)::bigint as value from l"""))(
    lambda spark, sf: reports.latest(queue_minutes(spark, sf).join(X.cameras(spark, sf).where("enabled").select("camera_id"), "camera_id", "left_semi"), ["camera_id", "queue_id"], "length_last", NOW).agg(F.sum("value").alias("value"))
)
query("wait_percentiles", with_sql("minutes", "queue_minute", body=f""")
select quantile_cont(wait_seconds, 0.5) as p50, quantile_cont(wait_seconds, 0.9) as p90, quantile_cont(wait_seconds, 0.95) as p95 from queue_minute where {A}"""))(
    lambda spark, sf: reports.wait_percentiles(reports.in_period(queue_minutes(spark, sf), "bucket_start", reports.bounds(WEEK), WEEK))
)
QLOC = f"""select location_id, sum(length_sum)::double / nullif(sum(sample_count), 0) as average_length, sum(wait_sum_seconds)::double / nullif(sum(wait_sample_count), 0) as average_wait, sum(throughput)::bigint as throughput,
  sum(sla_met)::double * 100 / nullif(sum(throughput), 0) as sla_percent, sum(warning_samples) * 2.0::double / 60 as warning_minutes, sum(critical_samples) * 2.0::double / 60 as critical_minutes
  from qhours where location_type = 'market' and location_id in (select market_id from cams where field_id = '1') and {A} group by 1 order by average_wait desc nulls last, location_id limit 500"""


def queue_locations(spark, sf):
    return reports.queue_locations(of(spark, sf, FIELD, queue_hours(spark, sf), FIELD.target()), 2.0)


query("queue_locations", qh(f"r as ({QLOC}) select * from r"))(queue_locations)
LATEST_Q = f"""lq as (select q.camera_id, queue_id, arg_max(length_last, bucket_start) as v from qm q where {RECENT} group by 1, 2
), cur as (select location_id, queue_id, sum(v)::bigint as current_length from lq join src on lq.camera_id = src.camera_id group by 1, 2)"""
query("latest_queue_by_id", with_sql("minutes", "queue_minute", "cams", body=QROWS + ")" + SRC + ", " + LATEST_Q + " select * from cur"))(
    lambda spark, sf: reports.latest_queue_by_id(queue_minutes(spark, sf), sources(spark, sf), NOW)
)
DETAILS = f"""det as (
  select location_id, location_type, queue_id, sum(length_sum)::double / nullif(sum(sample_count), 0) as average_length, max(length_max) as maximum_length, sum(wait_sum_seconds)::double / nullif(sum(wait_sample_count), 0) as average_wait,
         case when bool_or(physically_calibrated) then sum(movement_speed_sum_mpm)::double / nullif(sum(movement_speed_samples), 0) end as movement_speed, sum(throughput) / 168.0::double as throughput_per_hour,
         sum(sla_met)::double * 100 / nullif(sum(throughput), 0) as sla_percent, sum(warning_samples) * 2.0::double / 60 as warning_minutes, sum(critical_samples) * 2.0::double / 60 as critical_minutes
  from qm join src on qm.camera_id = src.camera_id where enabled and {A} group by 1, 2, 3
), details as (select det.*, current_length from det left join cur using (location_id, queue_id) order by average_wait desc nulls last, location_id, queue_id limit 500)"""


def queue_details(spark, sf):
    q = queue_minutes(spark, sf)
    return reports.queue_details(reports.in_period(q, "bucket_start", reports.bounds(WEEK), WEEK), sources(spark, sf), q, NOW, 168.0, 2.0)


query("queue_details", with_sql("minutes", "queue_minute", "cams", body=QROWS + ")" + SRC + ", " + LATEST_Q + ", " + DETAILS + " select * from details"))(queue_details)
query("queue_card", with_sql("minutes", "queue_minute", "cams", body=QROWS + ")" + SRC + ", " + LATEST_Q + ", " + DETAILS + " select count(*) as active_queues, arg_max(location_id, (current_length, average_wait, location_id)) as longest_location from details where current_length > 0"))(
    lambda spark, sf: reports.queue_card(queue_details(spark, sf))
)


def layer(spark, sf, other=False):
    rows = spatial(spark, sf).where("layer = 'occupancy'")
    return reports.in_period(rows, "bucket_start", reports.compared(WEEK) if other else reports.bounds(WEEK), WEEK)


def sp(body: str) -> str:
    return with_sql("minutes", "cams", body=")" + SPATIAL + ", " + body)


query("spatial_rows", sp(f"r as (select camera_id, zone_id, layer, count(*) as n, sum(p.value)::bigint as total from pt where {A} group by 1, 2, 3) select * from r"))(
    lambda spark, sf: reports.in_period(spatial(spark, sf), "bucket_start", reports.bounds(WEEK), WEEK).select("camera_id", "zone_id", "layer", F.explode("points").alias("p")).groupBy("camera_id", "zone_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("p.value").cast("long").alias("total"))
)
query("merge_spatial", sp(f"m as ({merged_sql(A)}) select x, y, round(value, 6) as value, round(least(1.0::double, abs(value) / (select max(abs(value)) from m)), 6) as intensity from m"))(
    lambda spark, sf: rounded(reports.merge_points(layer(spark, sf)), "value", "intensity")
)
query("difference_points", sp(f"a as ({merged_sql(A)}), b as ({merged_sql(B)}), d as (select coalesce(a.x, b.x) as x, coalesce(a.y, b.y) as y, coalesce(a.value, 0) - coalesce(b.value, 0) as value from a full join b on a.x = b.x and a.y = b.y) select x, y, round(value, 6) as value, round(value / (select max(abs(value)) from d), 6) as intensity from d"))(
    lambda spark, sf: rounded(reports.difference_points(reports.merge_points(layer(spark, sf)), reports.merge_points(layer(spark, sf, True))), "value", "intensity")
)
query("spatial_timeline", sp(f"t as (select distinct bucket_start from pt where layer = 'occupancy' and {A} order by 1 desc limit 336), m as (select bucket_start, p.x::int as x, p.y::int as y, avg(p.value) as value from pt where layer = 'occupancy' and bucket_start in (from t) group by 1, 2, 3) select bucket_start, x, y, value, value / max(abs(value)) over (partition by bucket_start) as intensity from m"))(
    lambda spark, sf: reports.spatial_timeline(layer(spark, sf))
)
query("zone_metrics", sp(f"m as (select zone_id, location_id, location_type, {', '.join(f'''avg(p.value) filter (layer = '{x}') as {x}''' for x in ('occupancy', 'dwell', 'traffic', 'congestion'))} from pt where {A} group by 1, 2, 3), c as (select zone_id, location_id, location_type, avg(coverage_percent) as coverage from sp where {A} group by 1, 2, 3) select m.*, coverage from m join c using (zone_id, location_id, location_type) order by 1, 2, 3 limit 500"))(
    lambda spark, sf: reports.zone_metrics(reports.in_period(spatial(spark, sf), "bucket_start", reports.bounds(WEEK), WEEK))
)
FEED = SRC + """, feed100 as (
  select event_id, f.camera_id, occurred_at, kind, location_id, location_type, case when kind like '%restricted_area_confirmed%' then 'critical' when kind like '%overflow%' then 'warning' else 'info' end as severity,
         case when kind like '%overflow%' then 'criticalMinutes' when kind like '%line_crossed%' then 'entries' end as metric_key
  from feed f join src on f.camera_id = src.camera_id order by occurred_at desc, event_id desc limit 100
)"""


def feed(spark, sf):
    return reports.event_feed(X.analytics_events(spark, sf), sources(spark, sf))


query("event_feed", with_sql("feed", "cams", body=")" + FEED + " select * from feed100"))(feed)
query("alerts", with_sql("feed", "cams", body=")" + FEED + " select * from feed100 where severity in ('critical', 'warning') order by occurred_at desc, event_id desc limit 10"))(lambda spark, sf: reports.alerts(feed(spark, sf)))
query("location_ranking", with_sql("minutes", "minute", "queue_minute", "cams", body=BOTH_HOURS + f", fl as ({LOCATIONS}), ql as ({QLOC}) select fl.location_id, entries as traffic, round(value, 6) as occupancy, sla_percent as queue_score from fl left join ql using (location_id) order by traffic desc, location_id limit 20"))(
    lambda spark, sf: rounded(reports.location_ranking(flow_locations(spark, sf), queue_locations(spark, sf)), "occupancy")
)
query("data_quality", h(f"s as ({summary_sql(FA)}), q as (select least(100.0::double, sample_count::double * 100 / nullif(expected_samples, 0)) as coverage, confidence_sum::double * 100 / nullif(sample_count, 0) as confidence, contributing_sources as contributing, (select count(*) from cams where enabled) as expected from s) select *, case when coalesce(coverage, 0) <= 0 then 'unavailable' when coverage >= 95 then 'live' else 'partial' end as status, expected > 0 and contributing < expected as partial_sources from q"))(
    lambda spark, sf: reports.data_quality(reports.flow_summary(flow(spark, sf)), reports.expected_sources(X.cameras(spark, sf), WEEK))
)


def kpi_sql(names: list[str]) -> str:
    picks = " union all ".join(f"select '{n}' as key, round(a.{n}::double, 6) as value, round(b.{n}::double, 6) as previous, a.{n}::double as v, b.{n}::double as w from a, b" for n in names)
    return f"k as ({picks}), kpis as (select key, value, previous, round(case when w <> 0 then (v - w) * 100 / w end, 6) as change_percent from k)"


FLOW_KEYS, QUEUE_KEYS = ["average_occupancy", "peak_occupancy", "entries", "exits"], ["average_length", "maximum_length", "average_wait", "throughput", "sla_met", "movement_speed"]


def flow_kpis(spark, sf):
    return reports.kpis(*[reports.flow_summary(flow(spark, sf, WEEK, o)) for o in (False, True)], FLOW_KEYS)


def queue_kpis(spark, sf):
    return reports.kpis(*[reports.queue_measures(queues(spark, sf, WEEK, o)) for o in (False, True)], QUEUE_KEYS)


def raw(sql: str) -> str:
    return sql.replace("round(avg(o), 6)", "avg(o)")


FLOW_KPIS = f"a as ({raw(summary_sql(FA))}), b as ({raw(summary_sql(FB))}), {kpi_sql(FLOW_KEYS)}"
query("flow_kpis", h(FLOW_KPIS + " select * from kpis"))(lambda spark, sf: rounded(flow_kpis(spark, sf), "value", "previous", "change_percent"))
query("queue_kpis", qh(f"a as (select {MEASURES} from qhours where {FA}), b as (select {MEASURES} from qhours where {FB}), {kpi_sql(QUEUE_KEYS)} select * from kpis"))(lambda spark, sf: rounded(queue_kpis(spark, sf), "value", "previous", "change_percent"))
query("important_changes", h(FLOW_KPIS + " select key, case when change_percent > 0 then 'up' else 'down' end as direction, change_percent from kpis where abs(change_percent) >= 5"))(
    lambda spark, sf: rounded(reports.important_changes(flow_kpis(spark, sf)), "change_percent")
)


@query("spatial_report", sp(f"""tag as (select 'A' as period, * from pt where {A} union all select 'B', * from pt where {B}
), cell as (select layer, period, p.x::int as x, p.y::int as y, avg(p.value) as value from tag group by 1, 2, 3, 4
), side as (select layer, x, y, max(value) filter (period = 'A') as a, max(value) filter (period = 'B') as b from cell group by 1, 2, 3
), cover as (select layer, avg(coverage_percent) as coverage from sp where {A} group by 1)
select layer, x, y, round(a, 6) as period_a, round(b, 6) as period_b, round(coalesce(a, 0) - coalesce(b, 0), 6) as difference, round(coverage, 6) as coverage from side join cover using (layer)"""))
def spatial_report(spark, sf):
    """Every layer's points in both periods, their difference, with the mean coverage."""
    rows = reports.tag_periods(spatial(spark, sf), "bucket_start", WEEK)
    cells = reports.merge_points(rows, "layer", "period")
    cover = rows.where("period = 'A'").groupBy("layer").agg(F.avg("coverage_percent").alias("coverage"))
    sides = cells.groupBy("layer", "x", "y").pivot("period", ["A", "B"]).agg(F.first("value"))
    sides = sides.withColumn("difference", F.coalesce("A", F.lit(0.0)) - F.coalesce("B", F.lit(0.0)))
    sides = sides.join(cover, "layer").select("layer", "x", "y", F.col("A").alias("period_a"), F.col("B").alias("period_b"), "difference", "coverage")
    return rounded(sides, "period_a", "period_b", "difference", "coverage")


@query("overview", with_sql("minutes", "minute", "queue_minute", "cams", body=BOTH_HOURS + SPATIAL + ", " + LATEST_Q + ", " + DETAILS + f"""
, flow_part as (with {FLOW_KPIS} select * from kpis
), queue_part as (with a as (select {MEASURES} from qhours where {FA}), b as (select {MEASURES} from qhours where {FB}), {kpi_sql(QUEUE_KEYS)} select * from kpis
), zone as (select zone_id, location_id, location_type, avg(p.value) filter (layer = 'dwell') as dwell from pt where {A} group by 1, 2, 3 order by 1, 2, 3 limit 500)
select * from flow_part union all select * from queue_part
union all select 'average_dwell', round(avg(dwell), 6), null, null from zone
union all select 'active_queues', count(*)::double, null, null from details where current_length > 0"""))
def overview(spark, sf):
    """The headline measures of all three reports as key, value, previous and change."""
    dwell = reports.zone_metrics(reports.in_period(spatial(spark, sf), "bucket_start", reports.bounds(WEEK), WEEK)).agg(F.avg("dwell").alias("value"))
    none = F.lit(None).cast("double")
    parts = [flow_kpis(spark, sf), queue_kpis(spark, sf), dwell.select(F.lit("average_dwell").alias("key"), "value", none.alias("previous"), none.alias("change_percent"))]
    card = reports.queue_card(queue_details(spark, sf)).select(F.lit("active_queues").alias("key"), F.col("active_queues").cast("double").alias("value"), none.alias("previous"), none.alias("change_percent"))
    return rounded(parts[0].union(parts[1]).union(parts[2]).union(card), "value", "previous", "change_percent")
