"""Restricted areas: lives of a track in a zone, alerts with a cooldown, and status by frame.

A life begins with the first frame inside, and ends at the first frame of the camera's clock where
the track has been outside, or missing, for the grace time. It is confirmed once it has dwelt; an
alert also needs the cooldown since the track's last alert in any life, and may come late, while
still inside. Native windows by camera, zone and track find the lives; events come from one pass over
sorted samples, which carries a track's last alert and nothing more.

``areas``: camera_id, zone_id, polygon, dwell, grace, cooldown, and, where a schedule is meant, days
(Monday is 0; null: always), from_minute, to_minute and timezone. A frame outside of the schedule
ends every life in the zone without an event. Times are seconds since 1970 in UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.functions.geometry import EPS
from flowlake.operators.blocks import block_of, next_of, next_time, running_totals
from flowlake.operators.people import zone_membership

ZONE = ["camera_id", "zone_id"]


def on_duty() -> Column:
    return G.schedule_active(F.timestamp_seconds("ts"), F.col("days"), F.col("from_minute"), F.col("to_minute"), F.col("timezone"))


def present(obs: DataFrame, frames: DataFrame, areas: DataFrame) -> DataFrame:
    """Samples inside an area on duty, with the settings and ``until``: the next frame off duty."""
    rows = zone_membership(obs, areas).where("inside")
    if "days" not in areas.columns:
        return rows.withColumn("until", F.lit(None).cast("double"))
    clock = frames.select("camera_id", "ts").join(areas.drop("polygon"), "camera_id").select(*ZONE, "ts", (~on_duty()).alias("off"))
    return next_time(rows.where(on_duty()), clock.where("off"), ZONE, "ts", "until")


def lives(inside: DataFrame, frames: DataFrame) -> DataFrame:
    """Inside samples with their life: the zone, track_id, ts, until, cooldown, entered_at, exited_at, confirmed_at."""
    track = Window.partitionBy(*ZONE, "track_id", "until").orderBy("ts")
    rows = inside.select(*ZONE, "track_id", "ts", "until", "dwell", "grace", "cooldown").join(next_of(frames, ["camera_id"], "after"), ["camera_id", "ts"]).withColumn("again", F.lead("ts").over(track))
    before_end = lambda c: F.col(c).isNotNull() & (F.col("until").isNull() | (F.col(c) < F.col("until")))
    rows = rows.withColumn("outside", F.when(before_end("after") & ~F.col("after").eqNullSafe(F.col("again")), F.col("after")))
    rows = next_time(rows.withColumn("due", F.col("outside") + F.col("grace")), frames, ["camera_id"], "due", "exit")
    ends = before_end("exit") & (F.col("again").isNull() | (F.col("exit") < F.col("again")))
    rows = rows.withColumn("ended", F.when(F.col("outside").isNotNull() & ends, F.col("exit")))
    rows = rows.withColumn("life", F.coalesce(F.sum(F.col("ended").isNotNull().cast("int")).over(track.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy(*ZONE, "track_id", "until", "life")
    rows = rows.withColumns({"entered_at": F.min("ts").over(life), "exited_at": F.max("ended").over(life)})
    ripe = F.when(F.col("ts") - F.col("entered_at") >= F.col("dwell") - EPS, F.col("ts"))
    rows = rows.withColumn("confirmed_at", F.min(ripe).over(life))
    return rows.select(*ZONE, "track_id", "ts", "until", "cooldown", "entered_at", "exited_at", "confirmed_at")


def whole_lives(rows: DataFrame) -> DataFrame:
    return rows.drop("ts", "cooldown").distinct()


EVENT = ["ts", "event_type", "seconds", "confirmed"]


def zone_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events of samples that are sorted by zone, track and time.

    Only the last sample's life and the track's last alert are carried from batch to batch. Lives are
    taken as runs of rows; within one, the first sample that is confirmed and cool is looked up.
    """
    who = [*ZONE, "track_id"]
    track, life, alerted, last = None, None, False, None
    for pdf in batches:
        if not len(pdf):
            continue
        entered, exited, ripe_from = (pdf[c].to_numpy(np.float64) for c in ("entered_at", "exited_at", "confirmed_at"))
        ts, cooldown = pdf["ts"].to_numpy(np.float64), pdf["cooldown"].to_numpy(np.float64)
        same = np.logical_and.reduce([(pdf[c] == pdf[c].shift()).to_numpy() for c in who])
        starts = np.flatnonzero(~same | (entered != np.append(np.nan, entered[:-1])))
        rows, found = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            here = tuple(pdf[c].iat[a] for c in who)
            if here != track:
                track, life, last = here, None, None
            if life != entered[a]:
                life, alerted = entered[a], False
                rows.append(a)
                found.append((entered[a], "restricted_area_entered", None, None))
                if not np.isnan(exited[a]):
                    rows.append(a)
                    found.append((exited[a], "restricted_area_exited", exited[a] - entered[a], bool(not np.isnan(ripe_from[a]))))
            if not alerted and not np.isnan(ripe_from[a]):
                due = ripe_from[a] if last is None else max(ripe_from[a], last + cooldown[a] - EPS)
                at = a + int(np.searchsorted(ts[a:b], due))
                if at < b:
                    alerted, last = True, ts[at]
                    rows.append(at)
                    found.append((ts[at], "restricted_area_confirmed", ts[at] - entered[a], None))
        out = pdf.iloc[rows][who].reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(found, columns=EVENT, dtype=object)], axis=1)


def restricted_events(obs: DataFrame, frames: DataFrame, areas: DataFrame) -> DataFrame:
    """camera_id, zone_id, track_id, ts, event_type, seconds (dwell or duration), confirmed."""
    rows, who = lives(present(obs, frames, areas), frames), [*ZONE, "track_id"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in who) + ", ts double, event_type string, seconds double, confirmed boolean"
    dealt = rows.repartition(*who).sortWithinPartitions(*who, "ts").select(*who, "ts", "cooldown", "entered_at", "exited_at", "confirmed_at")
    return dealt.mapInPandas(zone_events, schema)


def restricted_status(obs: DataFrame, frames: DataFrame, areas: DataFrame) -> DataFrame:
    """camera_id, zone_id, frame_index, active, current, entered, confirmed, entries, exits at each frame."""
    whole = whole_lives(lives(present(obs, frames, areas), frames))
    one, zero = F.lit(1), F.lit(0)
    was = F.when(F.col("confirmed_at").isNotNull(), -1).otherwise(0)
    steps = [("entered_at", one, zero, one, zero), ("confirmed_at", zero, one, zero, zero), ("exited_at", -one, was, zero, one)]
    changes = [F.struct(F.col(t).alias("ts"), d.alias("d"), c.alias("c"), i.alias("i"), o.alias("o")) for t, d, c, i, o in steps]
    dropped = F.when(F.col("exited_at").isNull(), F.col("until"))
    changes.append(F.struct(dropped.alias("ts"), (-one).alias("d"), was.alias("c"), zero.alias("i"), zero.alias("o")))
    changes = whole.select(*ZONE, F.inline(F.array(*changes))).where("ts is not null").groupBy(*ZONE, "ts").agg(*[F.sum(k).alias(k) for k in "dcio"])
    spine = frames.join(areas.drop("polygon"), "camera_id")
    active = on_duty() if "days" in areas.columns else F.lit(True)
    rows = spine.withColumn("active", active).join(changes, [*ZONE, "ts"], "left")
    rows = running_totals(rows, ZONE, ["ts"], block_of(F.col("ts")), {k: F.col(k) for k in "dcio"})
    return rows.select(*ZONE, "frame_index", "active", F.col("d").alias("current"), (F.col("d") - F.col("c")).alias("entered"), F.col("c").alias("confirmed"), F.col("i").alias("entries"), F.col("o").alias("exits"))


def recent_events(events: DataFrame, limit: int, camera_id: int | None = None) -> DataFrame:
    """The newest entered and exited events, of one camera or of all."""
    rows = events.where(F.col("event_type").isin("restricted_area_entered", "restricted_area_exited"))
    if camera_id is not None:
        rows = rows.where(F.col("camera_id") == camera_id)
    return rows.orderBy(F.col("ts").desc(), "camera_id", "track_id", "event_type").limit(limit)
