"""Queries over tracks and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators import blocks, heat, intrusion, motion, people
from flowlake.plans import fixtures as X
from flowlake.plans.fixtures import with_sql

QUERIES, ORACLES = {}, {}
BOUNDS = (0.0, 0.0, 100.0, 100.0)
SIZE = (X.WIDTH, X.HEIGHT)


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def clocked(spark, sf):
    obs = X.observations(spark, sf)
    return obs, X.frames(obs)


# The wedge (10,10) (90,10) (50,50) (90,90) (10,90): below y = 50 the right side is x <= 100 - y, above it x <= y.
INSIDE = """
), hit as (
  select *, px between 20 and 80 and py between 20 and 80 as in_floor,
         camera_id % 2 = 0 and px >= 10 and py between 10 and 90 and px <= case when py <= 50 then 100 - py else py end as in_wedge
  from seen"""

query(
    "zone_occupancy",
    with_sql("obs", "frames", "seen", body=INSIDE + """
), n as (
  select camera_id, frame_index, count(*) filter (in_floor) as floor, count(*) filter (in_wedge) as wedge from hit group by 1, 2
)
select f.camera_id, f.frame_index, z as zone_id, coalesce(case z when 'floor' then floor else wedge end, 0) as people
from frames f join (values ('floor'), ('wedge')) t(z) on z = 'floor' or f.camera_id % 2 = 0 left join n using (camera_id, frame_index)"""),
)(lambda spark, sf: (lambda o, f: people.zone_occupancy(o, f, X.zones(o)))(*clocked(spark, sf)))

query(
    "people_per_frame",
    with_sql("obs", "frames", "seen", body="""
), first as (select camera_id, track_id, min(frame_index) as f from seen group by 1, 2)
select camera_id, frame_index, (select count(*) from seen s where s.camera_id = f.camera_id and s.frame_index = f.frame_index) as current_people,
       (select count(*) from first a where a.camera_id = f.camera_id and a.f <= f.frame_index) as unique_people
from frames f"""),
)(lambda spark, sf: people.people_per_frame(*clocked(spark, sf)))

CROSSED = """
), numbered as (
  select *, row_number() over (partition by camera_id order by frame_index) as at_ from frames
), sighted as (
  select *, 'door' as line_id, px as along, py - 50 as off from seen union all select *, 'gate', py, 50 - px from seen where camera_id % 2 = 1
), far as (
  select s.*, at_, case when (60 * off) / 60.0::double > 0.03::double * sqrt(20000.0::double) then 1 when (60 * off) / 60.0::double < -0.03::double * sqrt(20000.0::double) then -1 else 0 end as side,
         coalesce((at_ - lag(at_) over (partition by s.camera_id, track_id, line_id order by at_) <> 1)::int, 0) as broken
  from sighted s join numbered n on s.camera_id = n.camera_id and s.frame_index = n.frame_index
), runs as (
  select *, sum(broken) over (partition by camera_id, track_id, line_id order by at_) as run from far
), moved as (
  select *, lag(side) over w as s0, lag(along) over w as x0, lag(off) over w as y0 from runs where side <> 0 window w as (partition by camera_id, track_id, line_id, run order by at_)
), crossed as (
  select camera_id, track_id, frame_index, line_id, case when side > s0 then 'entry' else 'exit' end as direction
  from moved where s0 <> side and x0 + (0 - y0) / (off - y0) * (along - x0) between 20 - 60e-9 and 80 + 60e-9"""


def crossings(spark, sf):
    obs, frames = clocked(spark, sf)
    return people.line_crossings(obs, frames, X.lines(obs), SIZE)


query("line_crossings", with_sql("obs", "frames", "seen", body=CROSSED + ") select * from crossed"))(crossings)


@query("line_totals", with_sql("obs", "frames", "seen", body=CROSSED + """
), n as (select camera_id, frame_index, line_id, count(*) filter (direction = 'entry') as i, count(*) filter (direction = 'exit') as o from crossed group by 1, 2, 3)
select f.camera_id, f.frame_index, l as line_id, (sum(coalesce(i, 0)) over w)::bigint as entries, (sum(coalesce(o, 0)) over w)::bigint as exits
from frames f join (values ('door'), ('gate')) t(l) on l = 'door' or f.camera_id % 2 = 1 left join n on n.camera_id = f.camera_id and n.frame_index = f.frame_index and n.line_id = l
window w as (partition by f.camera_id, l order by f.frame_index)"""))
def line_totals(spark, sf):
    obs, frames = clocked(spark, sf)
    return people.line_totals(crossings(spark, sf), frames, X.lines(obs))


MEMBER = """
), member as (
  select s.*, zone_id, dwell, px between lo and lo + 60 and py between lo and lo + 60
         and greatest(least(x2, lo + 60) - greatest(x1, lo), 0) * greatest(least(y2, lo + 60) - greatest(y1, lo), 0) / 72.0::double >= 0.75::double - 1e-9::double as inside
  from seen s join regions r on s.camera_id = r.camera_id"""

query("zone_membership", with_sql("obs", "frames", "seen", "regions", body=MEMBER + ") select camera_id, zone_id, track_id, frame_index, inside from member"))(
    lambda spark, sf: (lambda o: people.zone_membership(o, X.regions(o)))(X.observations(spark, sf)).select("camera_id", "zone_id", "track_id", "frame_index", "inside")
)

# The store is off duty from time 60 on, which ends its lives without an event.
LIVES = MEMBER + """
), clock as (
  select camera_id, ts, lead(ts) over (partition by camera_id order by ts) as after from frames
), ins as (
  select m.camera_id, zone_id, dwell, track_id, m.ts, after, lead(m.ts) over (partition by m.camera_id, zone_id, track_id order by m.ts) as again,
         case when zone_id = 'store' then (select min(ts) from frames f where f.camera_id = m.camera_id and f.ts >= 60) end as until
  from member m join clock c on m.camera_id = c.camera_id and m.ts = c.ts where inside and (zone_id = 'secure' or m.ts < 60)
), out_ as (
  select *, case when after is distinct from again and (until is null or after < until) then after end as outside from ins
), due as (
  select *, (select min(ts) from frames f where f.camera_id = o.camera_id and f.ts >= o.outside + 1 - 1e-9) as exit_ from out_ o
), flag as (
  select *, case when exit_ is not null and (until is null or exit_ < until) and (again is null or exit_ < again) then exit_ end as ended from due
), numbered_life as (
  select *, coalesce(sum((ended is not null)::int) over (partition by camera_id, zone_id, track_id order by ts rows between unbounded preceding and 1 preceding), 0) as life from flag
), life as (
  select *, min(ts) over w as entered_at, max(ended) over w as exited_at from numbered_life window w as (partition by camera_id, zone_id, track_id, life)
), whole as (
  select *, min(case when ts - entered_at >= dwell - 1e-9 then ts end) over (partition by camera_id, zone_id, track_id, life) as confirmed_at from life
)"""

ALERTS = """, ripe as (
  select camera_id, zone_id, track_id, ts, life, entered_at, row_number() over (partition by camera_id, zone_id, track_id order by ts) as k from whole where ts >= confirmed_at
), fold as (
  select camera_id, zone_id, track_id, k, ts, entered_at, ts as last, life as alerted, true as alert from ripe where k = 1
  union all
  select r.camera_id, r.zone_id, r.track_id, r.k, r.ts, r.entered_at,
         case when r.life <> f.alerted and r.ts - f.last >= 10 - 1e-9 then r.ts else f.last end,
         case when r.life <> f.alerted and r.ts - f.last >= 10 - 1e-9 then r.life else f.alerted end,
         r.life <> f.alerted and r.ts - f.last >= 10 - 1e-9
  from fold f join ripe r on r.camera_id = f.camera_id and r.zone_id = f.zone_id and r.track_id = f.track_id and r.k = f.k + 1
), one as (select distinct camera_id, zone_id, track_id, life, until, entered_at, exited_at, confirmed_at from whole)"""

EVENTS = """
  select zone_id, camera_id, track_id, entered_at as ts, 'restricted_area_entered' as event_type, null::double as seconds, null::boolean as confirmed from one
  union all select zone_id, camera_id, track_id, ts, 'restricted_area_confirmed', ts - entered_at, null from fold where alert
  union all select zone_id, camera_id, track_id, exited_at, 'restricted_area_exited', exited_at - entered_at, confirmed_at is not null from one where exited_at is not null"""


def restricted(spark, sf):
    obs, frames = clocked(spark, sf)
    return intrusion.restricted_events(obs, frames, X.areas(obs))


def secured(spark, sf):
    obs, frames = clocked(spark, sf)
    return intrusion.restricted_status(obs, frames, X.areas(obs))


NEEDS = ("obs", "frames", "seen", "regions")
query("restricted_events", with_sql(*NEEDS, body=LIVES + ALERTS + EVENTS, recursive=True))(restricted)
query(
    "recent_restricted_events",
    with_sql(*NEEDS, body=LIVES + ALERTS + f", e as ({EVENTS}) select * from e where event_type <> 'restricted_area_confirmed' order by ts desc, camera_id, zone_id, track_id, event_type limit 100", recursive=True),
)(lambda spark, sf: intrusion.recent_events(restricted(spark, sf), 100))

SECURED = """
, one as (select distinct camera_id, zone_id, track_id, life, entered_at, coalesce(exited_at, until) as gone_at, exited_at, confirmed_at from whole)
, secured as (select f.camera_id, r.zone_id, f.frame_index, r.zone_id = 'secure' or f.ts < 60 as active,
  count(*) filter (entered_at <= ts and (gone_at is null or gone_at > ts)) as current,
  count(*) filter (entered_at <= ts and (gone_at is null or gone_at > ts) and (confirmed_at is null or confirmed_at > ts)) as entered,
  count(*) filter (confirmed_at <= ts and (gone_at is null or gone_at > ts)) as confirmed,
  count(*) filter (entered_at <= ts) as entries, count(*) filter (exited_at <= ts) as exits
from frames f join regions r on f.camera_id = r.camera_id left join one o on f.camera_id = o.camera_id and r.zone_id = o.zone_id group by 1, 2, 3, 4)"""
query("restricted_status", with_sql(*NEEDS, body=LIVES + SECURED + " select * from secured"))(secured)

LAST = """
), last as (
  select *, case when px between 0 and 100 and py between 0 and 100 then least(floor(py * {h} / 100.0::double)::int, {h} - 1) end as row,
         least(floor(px * {w} / 100.0::double)::int, {w} - 1) as col
  from obs qualify row_number() over (partition by camera_id, frame_index, track_id order by arrival desc) = 1
"""
DWELL = """), steps as (
  select *, lead(ts) over w - ts as gap, lead(confirmed) over w as next_ok from last window w as (partition by camera_id, track_id order by ts)
"""

query("heatmap_occupancy", with_sql("obs", body=LAST.format(w=8, h=6) + ") select camera_id, row, col, count(*) as occupancy from last where confirmed and row is not null group by 1, 2, 3"))(
    lambda spark, sf: heat.occupancy(X.observations(spark, sf), 8, 6, BOUNDS)
)
query("heatmap_dwell", with_sql("obs", body=LAST.format(w=8, h=6) + DWELL + ") select camera_id, row, col, sum(gap) as dwell_seconds from steps where confirmed and next_ok and gap > 0 and gap <= 2 and row is not null group by 1, 2, 3"))(
    lambda spark, sf: heat.dwell(X.observations(spark, sf), 8, 6, BOUNDS, 2.0)
)
query("heatmap_windows", with_sql("obs", "frames", body=LAST.format(w=4, h=2) + """), clock as (
  select camera_id, ts, row_number() over (partition by camera_id order by ts) as k from frames
), rolled as (
  select camera_id, k, ts, ts as window_start from clock where k = 1
  union all select c.camera_id, c.k, c.ts, case when c.ts >= r.window_start + 20 then c.ts else r.window_start end from rolled r join clock c on c.camera_id = r.camera_id and c.k = r.k + 1
), placed as (select l.*, window_start from last l join rolled r on l.camera_id = r.camera_id and l.ts = r.ts
), steps as (
  select *, lead(ts) over w - ts as gap, lead(confirmed) over w as next_ok from placed window w as (partition by camera_id, window_start, track_id order by ts)
)
select camera_id, window_start, row, col, count(*) as occupancy, coalesce(sum(gap) filter (next_ok and gap > 0 and gap <= 2), 0) as dwell_seconds
from steps where confirmed and row is not null group by 1, 2, 3, 4""", recursive=True))(
    lambda spark, sf: heat.windowed(*clocked(spark, sf), 20.0, 4, 2, BOUNDS, 2.0)
)


def matrix():
    return F.array(*map(F.lit, X.HOMOGRAPHY))


query("heatmap_ground", with_sql("obs", body=LAST.format(w=10, h=10) + DWELL + """)
select camera_id, row, col, count(*) as occupancy, coalesce(sum(gap) filter (next_ok and gap > 0 and gap <= 2), 0) as dwell_seconds
from steps where confirmed and row is not null group by 1, 2, 3"""))(
    lambda spark, sf: heat.ground(X.observations(spark, sf), matrix(), 10, 10, (0.0, 0.0, 10.0, 10.0), 2.0)
)

CELLS = LAST.format(w=8, h=6) + """), cells as (
  select camera_id, row, col, count(*) as occupancy from last where confirmed and row is not null group by 1, 2, 3
"""
query("crowded_regions", with_sql("obs", body=CELLS + """), mean as (
  select camera_id, row // 2 * 4 + col // 2 + 1 as region_id, sum(occupancy) / 4.0::double as average from cells group by 1, 2
), spine as (select c.camera_id, r as region_id from (select distinct camera_id from cells) c, range(1, 13) t(r)
), ranked as (
  select camera_id, region_id, coalesce(average, 0) as average, row_number() over (partition by camera_id order by coalesce(average, 0) desc, region_id) as rank
  from spine left join mean using (camera_id, region_id)
) select * from ranked where rank <= 3"""))(
    lambda spark, sf: heat.crowded_regions(heat.occupancy(X.observations(spark, sf), 8, 6, BOUNDS), 8, 6)
)


@query("region_layers", with_sql("obs", body=LAST.format(w=8, h=6) + DWELL + """), cells as (
  select camera_id, row, col, count(*) as occupancy, coalesce(sum(gap) filter (next_ok and gap > 0 and gap <= 2), 0) as dwell_seconds
  from steps where confirmed and row is not null group by 1, 2, 3
), spine as (
  select camera_id, r, c, max(occupancy) as most, max(dwell_seconds) / 60 as longest from cells, range(3) a(r), range(4) b(c) group by 1, 2, 3
), region as (
  select s.camera_id, r, c, most, longest, coalesce(sum(occupancy), 0) / 4.0::double as o, coalesce(sum(dwell_seconds), 0) / 4.0::double / 60 as d
  from spine s left join cells k on k.camera_id = s.camera_id and row // 2 = r and col // 2 = c group by 1, 2, 3, 4, 5
), top as (select *, case when max(o) over (partition by camera_id) > 0 then max(o) over (partition by camera_id) else 1 end as top from region)
select camera_id, (c + 0.5::double) * 25 as x, (r + 0.5::double) * 100 / 3 as y, l as layer,
       case l when 'dwell' then d when 'congestion' then o * 100 / top else o end as value,
       case l when 'dwell' then case when longest > 0 then d / longest else 0 end when 'congestion' then o / top else case when most > 0 then o / most else 0 end end as intensity
from top, (values ('occupancy'), ('dwell'), ('traffic'), ('congestion')) t(l)"""))
def region_layers(spark, sf):
    obs = X.observations(spark, sf)
    cells = heat.occupancy(obs, 8, 6, BOUNDS).join(heat.dwell(obs, 8, 6, BOUNDS, 2.0), ["camera_id", "row", "col"], "left").fillna({"dwell_seconds": 0.0})
    return heat.region_layers(cells, 8, 6)


query("smooth_grid", with_sql("obs", body=CELLS + f"""), k as (
  select unnest(range(-4, 5)) as step, unnest({heat.kernel(1.0)}::double[]) as weight
), wide as (
  select camera_id, row, col + step as col, sum(occupancy * weight) as v from cells, k where col + step between 0 and 7 group by 1, 2, 3
), blurred as (
  select camera_id, row + step as row, col, sum(v * weight) as v from wide, k where row + step between 0 and 5 group by 1, 2, 3
)
select camera_id, row, col, floor(v * 1000000 + 0.5::double)::bigint as smoothed_millionths from blurred"""))(
    lambda spark, sf: heat.smooth(heat.occupancy(X.observations(spark, sf), 8, 6, BOUNDS), 8, 6, 1.0).select("camera_id", "row", "col", F.floor(F.col("smoothed") * 1000000 + F.lit(0.5)).alias("smoothed_millionths"))
)
query("export_grid", with_sql("obs", body=CELLS + """), spine as (select c.camera_id, r as row, k as col from (select distinct camera_id from cells) c, range(6) a(r), range(8) b(k))
select camera_id, row, string_agg(coalesce(occupancy, 0)::varchar, ',' order by col) as line from spine left join cells using (camera_id, row, col) group by 1, 2"""))(
    lambda spark, sf: heat.export_grid(heat.occupancy(X.observations(spark, sf), 8, 6, BOUNDS), 8, 6)
)


def speeds(spark, sf):
    return motion.speed(X.observations(spark, sf), matrix())


TOWARD = "case when sqrt(({x} - {px}) * ({x} - {px}) + ({y} - {py}) * ({y} - {py})) <= 1e-12 then 0 * {vx} * {vy} else ({vx} * ({x} - {px}) + {vy} * ({y} - {py})) / sqrt(({x} - {px}) * ({x} - {px}) + ({y} - {py}) * ({y} - {py})) end"
TOWARD_PX = TOWARD.format(x=80, y=50, px="px", py="py", vx="vx", vy="vy")
TOWARD_M = TOWARD.format(x=8, y=5, px="at_x", py="at_y", vx="vx / 10", vy="vy / 10")

query("speed", with_sql("obs", "seen", "judged", "speeds", recursive=True, body=""")
select camera_id, track_id, frame_index, ts, px, py, speed_px, speed_m, reason, vx, vy, vx / 10 as gvx, vy / 10 as gvy, at_x, at_y, judged_ as judged from speeds"""))(speeds)
query("speed_summary", with_sql("obs", "seen", "judged", "speeds", recursive=True, body=") select camera_id, frame_index, avg(speed_px) as mean_px, avg(speed_m) as mean_m from speeds group by 1, 2"))(
    lambda spark, sf: motion.speed_summary(speeds(spark, sf))
)
query("queue_progress", with_sql("obs", "seen", "judged", "speeds", recursive=True, body=f") select camera_id, track_id, frame_index, round({TOWARD_PX}, 6) + 0.0::double as progress, round({TOWARD_M}, 6) + 0.0::double as progress_m from speeds"))(
    lambda spark, sf: motion.queue_progress(speeds(spark, sf), (80.0, 50.0), G.point(F.lit(8.0), F.lit(5.0))).withColumns({k: F.round(k, 6) + 0.0 for k in ("progress", "progress_m")})
)
query("ema_trajectory", with_sql("obs", "seen", recursive=True, body="""
), n as (select *, row_number() over (partition by camera_id, track_id order by ts) as k from seen
), fold as (
  select camera_id, track_id, k, frame_index, ts, px as sx, py as sy from n where k = 1
  union all select n.camera_id, n.track_id, n.k, n.frame_index, n.ts, 0.35::double * px + (1 - 0.35::double) * sx, 0.35::double * py + (1 - 0.35::double) * sy
  from fold f join n on n.camera_id = f.camera_id and n.track_id = f.track_id and n.k = f.k + 1
) select camera_id, track_id, frame_index, ts, sx, sy, least(k, 30) as n_history from fold"""))(
    lambda spark, sf: motion.ema_trajectory(X.observations(spark, sf))
)
query("throttle", with_sql("obs", "frames", recursive=True, body="""
), n as (select *, row_number() over (partition by camera_id order by ts) as k from frames
), fold as (
  select camera_id, k, frame_index, ts, ts as kept from n where k = 1
  union all select n.camera_id, n.k, n.frame_index, n.ts, case when n.ts - kept >= 3 then n.ts else kept end from fold f join n on n.camera_id = f.camera_id and n.k = f.k + 1
) select camera_id, frame_index, ts from fold where ts = kept"""))(lambda spark, sf: motion.throttle(X.observations(spark, sf), 3.0))

VISITS = MEMBER + f"""
), fast as (
  select m.*, judged_, speed_m, {TOWARD_PX.replace("px", "m.px").replace("py", "m.py")} as progress_px, {TOWARD_M} as progress_m, coalesce(judged_ <= 45 + 1e-9, true) and inside as good
  from member m join speeds s on s.camera_id = m.camera_id and s.track_id = m.track_id and s.frame_index = m.frame_index
)""" + """, late as (
  select *, (select min(ts) from frames c where c.camera_id = f.camera_id and c.ts - f.ts > 1 + 1e-9) as late, lead(ts) over w as next_ts, lead(good) over w as next_good, lead(inside) over w as next_in, lead(px) over w as nx, lead(py) over w as ny
  from fast f window w as (partition by camera_id, zone_id, track_id order by ts)
), ends as (
  select *, late is not null and (next_ts is null or late < next_ts) as lapsed from late
), left_ as (
  select *, case when lapsed then late when next_ts is not null and not next_good then next_ts end as left_at,
         case when lapsed then 'tracking_gap' when next_ts is not null and not next_good then case when next_in then 'speed_exceeded' else 'outside_polygon' end end as reason,
         case when lapsed then px else nx end as ex, case when lapsed then py else ny end as ey
  from ends where good
), visit as (
  select *, coalesce(sum((left_at is not null)::int) over (partition by camera_id, zone_id, track_id order by ts rows between unbounded preceding and 1 preceding), 0) as visit from left_
), since as (select *, min(ts) over (partition by camera_id, zone_id, track_id, visit) as since from visit
), stay as (
  select camera_id, zone_id as queue_id, track_id, since, min(case when ts - since >= dwell - 1e-9 then ts end) as joined_at, max(left_at) as left_at, max(reason) as reason, arg_max(ex, ts) as ex, arg_max(ey, ts) as ey
  from since group by camera_id, zone_id, track_id, visit, since
), visits as (
  select camera_id, queue_id, track_id, since, joined_at, left_at, reason, case when joined_at is not null and left_at is not null then left_at - since end as waiting,
         case when joined_at is not null and left_at is not null then sqrt((ex / 100 - 0.8::double) * (ex / 100 - 0.8::double) + (ey / 100 - 0.5::double) * (ey / 100 - 0.5::double)) <= 0.08::double + 1e-9 end as completed
  from stay
)"""


def visits(spark, sf):
    obs, frames = clocked(spark, sf)
    return motion.queue_visits(obs, frames, X.queues(obs), SIZE, motion.speed(obs, matrix()))


LINED = (*NEEDS[:3], "judged", "speeds", NEEDS[3])
query("queue_membership", with_sql(*LINED, recursive=True, body=VISITS + " select * from visits"))(visits)

STATUS = """, status as (
  select f.camera_id, r.zone_id as queue_id, f.frame_index, f.ts, count(*) filter (joined_at <= ts and (left_at is null or left_at > ts)) as raw_count,
         avg(ts - since) filter (joined_at <= ts and (left_at is null or left_at > ts)) as mean_wait,
         count(*) filter (left_at <= ts and completed) as completed, avg(waiting) filter (left_at <= ts and completed) as mean_completed,
         arg_max(waiting, left_at * 1000000 + track_id) filter (left_at <= ts and completed) as last_wait
  from frames f join regions r on f.camera_id = r.camera_id left join visits v on f.camera_id = v.camera_id and r.zone_id = v.queue_id group by 1, 2, 3, 4
)"""
MEASURES = ("speed_px", "speed_m", "progress_px", "progress_m")
SPANS = """, spans as (
  select camera_id, zone_id as queue_id, ts as begun, coalesce(left_at, lead(ts) over (partition by camera_id, zone_id, track_id, visit order by ts)) as until, judged_ as speed_px, speed_m, progress_px, progress_m
  from since where ts - since >= dwell - 1e-9
), told as (
  select s.camera_id, s.queue_id, s.frame_index, """ + ", ".join(f"sum(round_even({m} * 1000000, 0)) / count({m}) / 1000000 as {m}" for m in MEASURES) + """
  from status s left join spans p on p.camera_id = s.camera_id and p.queue_id = s.queue_id and begun <= ts and (until is null or until > ts) group by 1, 2, 3
)"""
SMOOTHED = """, counted as (
  select *, row_number() over (partition by camera_id, queue_id order by ts) as k from status
), smooth as (
  select camera_id, queue_id, k, frame_index, 0.5::double * raw_count as level from counted where k = 1
  union all select n.camera_id, n.queue_id, n.k, n.frame_index, 0.5::double * n.raw_count + 0.5::double * level from smooth f join counted n on n.camera_id = f.camera_id and n.queue_id = f.queue_id and n.k = f.k + 1
), smoothed as (
  select camera_id, queue_id, frame_index, ts, raw_count, raw_count > 0 as present, raw_count >= 3 as overflow, mean_wait, completed, mean_completed, last_wait, level as smoothed_count, speed_px, speed_m, progress_px, progress_m
  from counted join smooth using (camera_id, queue_id, frame_index) join told using (camera_id, queue_id, frame_index)
)"""
FLIPS = """, flips as (
  select *, raw_count >= 3 as over_, lag(raw_count >= 3, 1, false) over (partition by camera_id, queue_id order by ts) as was from status
), overflows as (
  select camera_id, queue_id, ts, case when over_ then 'queue_overflow_started' else 'queue_overflow_ended' end as event_type, raw_count from flips where over_ <> was
)"""


def status(spark, sf):
    obs, frames = clocked(spark, sf)
    samples = blocks.settled(motion.queue_samples(obs, frames, X.queues(obs), motion.speed(obs, matrix())))
    return motion.queue_status(motion.visits_of(samples, SIZE), frames, X.queues(obs), motion.member_measures(samples, SIZE))


query("queue_status", with_sql(*LINED, recursive=True, body=VISITS + STATUS + SPANS + SMOOTHED + " select * from smoothed"))(status)
query("queue_overflow_events", with_sql(*LINED, recursive=True, body=VISITS + STATUS + FLIPS + " select * from overflows"))(lambda spark, sf: overflows(*map(blocks.settled, clocked(spark, sf))))


def overflows(obs, frames):
    visits_ = motion.queue_visits(obs, frames, X.queues(obs), SIZE, motion.speed(obs, matrix()))
    return motion.overflow_events(motion.queue_counts(visits_, frames, X.queues(obs)))


def rows(spark, sf):
    return motion.vertical_rows(X.observations(spark, sf), X.WIDTH)


query("vertical_rows")(rows)
query("stable_row_ids")(lambda spark, sf: motion.stable_row_ids(rows(spark, sf), clocked(spark, sf)[1], X.WIDTH))
query("active_and_expired_tracks", with_sql("obs", "frames", body="""
), last as (select camera_id, track_id, max(frame_index) as f from obs group by 1, 2
), clock as (select *, lag(frame_index) over (partition by camera_id order by frame_index) as before from frames
), n as (
  select c.camera_id, c.frame_index, (select count(distinct track_id) from obs o where o.camera_id = c.camera_id and o.frame_index = c.frame_index) as active,
         (select count(*) from last l where l.camera_id = c.camera_id and l.f = c.before) as expired from clock c
) select *, (sum(expired) over (partition by camera_id order by frame_index))::bigint as lost from n"""))(lambda spark, sf: people.active_and_lost(*clocked(spark, sf)))


@query("run_summary", with_sql("obs", "frames", "seen", body=INSIDE + CROSSED + """
), zone as (select camera_id, frame_index, count(*) filter (in_floor) as a, count(*) filter (in_wedge) as b, count(*) as p from hit group by 1, 2)
select f.camera_id, count(*) as frames, max(coalesce(p, 0)) as max_people, (select count(distinct track_id) from seen s where s.camera_id = f.camera_id) as unique_people,
       max(coalesce(greatest(a, b), 0)) as max_zone_people,
       (select count(*) from crossed c where c.camera_id = f.camera_id and direction = 'entry') as entries, (select count(*) from crossed c where c.camera_id = f.camera_id and direction = 'exit') as exits
from frames f left join zone using (camera_id, frame_index) group by f.camera_id"""))
def run_summary(spark, sf):
    obs, frames = clocked(spark, sf)
    return people.run_summary(obs, frames, X.zones(obs), crossings(spark, sf))


METRICS = """
, people as (
  select f.camera_id, f.frame_index, coalesce(count(s.track_id), 0) as current_people, (select count(*) from (select camera_id, track_id, min(frame_index) as f from seen group by 1, 2) a where a.camera_id = f.camera_id and a.f <= f.frame_index) as unique_people
  from frames f left join seen s on s.camera_id = f.camera_id and s.frame_index = f.frame_index group by f.camera_id, f.frame_index
), passed as (
  select f.camera_id, f.frame_index, (select count(*) from crossed c where c.camera_id = f.camera_id and c.frame_index <= f.frame_index and direction = 'entry') as entries,
         (select count(*) from crossed c where c.camera_id = f.camera_id and c.frame_index <= f.frame_index and direction = 'exit') as exits from frames f
), inside as (
  select f.camera_id, f.frame_index, count(*) filter (in_floor) as floor_, count(*) filter (in_wedge) as wedge_ from frames f left join hit h on h.camera_id = f.camera_id and h.frame_index = f.frame_index group by 1, 2
), guarded as (
  select camera_id, frame_index, string_agg(zone_id || '=' || current || '/' || confirmed || '/' || entries || '/' || exits, ',' order by zone_id) as restricted from secured group by 1, 2
), lined as (
  select camera_id, frame_index, string_agg(queue_id || '=' || raw_count || '/' || completed, ',' order by queue_id) as queues from status group by 1, 2
)
select *, 'floor=' || floor_ || case when camera_id % 2 = 0 then ',wedge=' || wedge_ else '' end as zones from people join passed using (camera_id, frame_index) join inside using (camera_id, frame_index) join guarded using (camera_id, frame_index) join lined using (camera_id, frame_index)"""


def told(rows, name, *parts):
    """One text for each frame: the named rows with their numbers, in order of their names."""
    text = F.concat(name, F.lit("="), F.array_join(F.array(*[F.col(p).cast("string") for p in parts]), "/"))
    return rows.groupBy("camera_id", "frame_index").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("told"))


@query("frame_metrics", with_sql(*LINED, recursive=True, body=INSIDE + CROSSED + LIVES + SECURED + VISITS.replace(MEMBER + "\n), fast", ", fast", 1) + STATUS + METRICS.replace("select *, 'floor='", "select camera_id, frame_index, current_people, unique_people, entries, exits, restricted, queues, 'floor='")))
def frame_metrics(spark, sf):
    """One row for each frame: people, totals of lines, zones, restricted areas and queues."""
    obs, frames = clocked(spark, sf)
    return people.frame_metrics(
        people.people_per_frame(obs, frames), line_totals(spark, sf), told(people.zone_occupancy(obs, frames, X.zones(obs)), "zone_id", "people"),
        told(secured(spark, sf), "zone_id", "current", "confirmed", "entries", "exits"), told(status(spark, sf), "queue_id", "raw_count", "completed"),
    )


@query("collect_events", with_sql(*LINED, recursive=True, body=CROSSED + LIVES + ALERTS + VISITS.replace(MEMBER + "\n), fast", ", fast", 1) + STATUS + FLIPS + f", e as ({EVENTS})" + """
select camera_id, track_id, frame_index::double as ts, 'line_crossed' as event_type, line_id, direction, null as zone_id, null::double as seconds, null::boolean as confirmed, null as queue_id, null::bigint as raw_count from crossed
union all select camera_id, track_id, ts, event_type, null, null, zone_id, seconds, confirmed, null, null from e
union all select camera_id, null, ts, event_type, null, null, null, null, null, queue_id, raw_count from overflows"""))
def collect_events(spark, sf):
    obs = blocks.settled(X.observations(spark, sf))
    frames = blocks.settled(X.frames(obs))
    crossed = people.line_crossings(obs, frames, X.lines(obs), SIZE).select("camera_id", "track_id", F.col("frame_index").cast("double").alias("ts"), F.lit("line_crossed").alias("event_type"), "line_id", "direction")
    return people.collect_events(crossed, intrusion.restricted_events(obs, frames, X.areas(obs)), overflows(obs, frames))
