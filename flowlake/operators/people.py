"""Counting people: occupancy of zones, people per frame, line crossings.

Observations have camera_id, track_id, frame_index, ts, px, py (the foot point), x1..y2, confirmed
and arrival; frames are the camera's clock. Zones, lines and regions are configuration: rows of a
camera, joined by camera_id, so that a fleet with many layouts takes one pass and a camera without a
row takes no part. Everything else is dealt by camera, or by camera and track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators.blocks import block_of, next_time, running_totals

FRAMES = 4096.0  # frames in a block
COVERAGE = 0.75


def dedupe_frame(obs: DataFrame, confirmed_first: bool = True) -> DataFrame:
    """The last write for each camera, frame and track; unconfirmed rows go before or stay."""
    rows = obs.where("confirmed") if confirmed_first else obs
    last = Window.partitionBy("camera_id", "frame_index", "track_id").orderBy(F.col("arrival").desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def reject_out_of_order(obs: DataFrame) -> DataFrame:
    """``valid`` is false for rows whose time lies before their camera's latest time so far."""
    before = Window.partitionBy("camera_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return obs.withColumn("valid", F.coalesce(F.col("ts") >= F.max("ts").over(before), F.lit(True)))


def zone_hits(seen: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows of people inside a zone of their camera, one for each zone they are in."""
    rows = seen.join(zones.select("camera_id", "zone_id", G.edges(F.col("polygon")).alias("edges")), "camera_id")
    return rows.where(G.in_edges(G.point(F.col("px"), F.col("py")), F.col("edges"))).drop("edges")


def zone_occupancy(obs: DataFrame, frames: DataFrame, zones: DataFrame) -> DataFrame:
    """camera_id, frame_index, zone_id, people; zero rows for frames without anyone.

    ``zones``: camera_id, zone_id, polygon.
    """
    hits = zone_hits(dedupe_frame(obs), zones).groupBy("camera_id", "frame_index", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    spine = frames.select("camera_id", "frame_index").join(zones.select("camera_id", "zone_id"), "camera_id")
    rows = spine.join(hits, ["camera_id", "frame_index", "zone_id"], "left")
    return rows.select("camera_id", "frame_index", "zone_id", F.coalesce("n", F.lit(0)).alias("people"))


def people_per_frame(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """camera_id, frame_index, current_people, unique_people (distinct since the start)."""
    seen = dedupe_frame(obs)
    current = seen.groupBy("camera_id", "frame_index").agg(F.count(F.lit(1)).alias("current"))
    new = seen.groupBy("camera_id", "track_id").agg(F.min("frame_index").alias("frame_index"))
    new = new.groupBy("camera_id", "frame_index").agg(F.count(F.lit(1)).alias("new"))
    rows = frames.select("camera_id", "frame_index").join(current, ["camera_id", "frame_index"], "left").join(new, ["camera_id", "frame_index"], "left")
    rows = running_totals(rows, ["camera_id"], ["frame_index"], block_of(F.col("frame_index"), FRAMES), {"unique_people": F.col("new")})
    return rows.select("camera_id", "frame_index", F.coalesce("current", F.lit(0)).alias("current_people"), "unique_people")


def frame_numbers(frames: DataFrame) -> DataFrame:
    """The camera's frames numbered without gaps."""
    return frames.select("camera_id", "frame_index", F.row_number().over(Window.partitionBy("camera_id").orderBy("ts", "frame_index")).alias("at"))


def line_crossings(obs: DataFrame, frames: DataFrame, lines: DataFrame, size: tuple[int, int]) -> DataFrame:
    """One row for each completed crossing: camera_id, track_id, frame_index, line_id, direction.

    ``lines``: camera_id, line_id, start and end (normalised points), hysteresis (a share of the
    frame's diagonal), positive and negative (the labels of the two directions). A track that misses
    a frame of its camera starts anew. Samples within the dead band are skipped; each other is
    compared to the last one outside the band.
    """
    w, h = (float(n - 1) for n in size)
    pixel = lambda p: G.point(F.col(p)["x"] * w, F.col(p)["y"] * h)
    dims = lines.select("camera_id", "line_id", pixel("start").alias("la"), pixel("end").alias("lb"), (F.col("hysteresis") * F.sqrt(F.lit(w * w + h * h))).alias("band"), "positive", "negative")
    rows = dedupe_frame(obs).join(frame_numbers(frames), ["camera_id", "frame_index"])
    track = Window.partitionBy("camera_id", "track_id").orderBy("at")
    rows = rows.withColumn("broken", (F.col("at") - F.lag("at").over(track) != 1).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("broken", F.lit(0))).over(track)).join(dims, "camera_id")
    dx, dy = F.col("lb.x") - F.col("la.x"), F.col("lb.y") - F.col("la.y")
    far, band = G.signed_side(G.point(F.col("px"), F.col("py")), F.col("la"), F.col("lb")) / F.sqrt(dx * dx + dy * dy), F.col("band")
    rows = rows.withColumn("side", F.when(far > band, 1).when(far < -band, -1).otherwise(0)).where("side <> 0")
    run = Window.partitionBy("camera_id", "track_id", "line_id", "run").orderBy("at")
    before = F.lag(F.struct("side", "px", "py")).over(run)
    moved = rows.withColumn("before", before).where("before.side <> side")
    crossing = G.segment_crossing(G.point(F.col("before.px"), F.col("before.py")), G.point(F.col("px"), F.col("py")), F.col("la"), F.col("lb"))
    moved = moved.withColumn("c", crossing).where("c.crossed")
    label = F.when(F.col("c.direction") == "negative_to_positive", F.col("positive")).otherwise(F.col("negative"))
    return moved.select("camera_id", "track_id", "frame_index", "line_id", label.alias("direction"))


def line_totals(crossings: DataFrame, frames: DataFrame, lines: DataFrame, labels: tuple[str, str] = ("entry", "exit")) -> DataFrame:
    """camera_id, frame_index, line_id, entries, exits: totals of each line up to each frame."""
    count = lambda d: F.count_if(F.col("direction") == d)
    key = ["camera_id", "frame_index", "line_id"]
    here = crossings.groupBy(*key).agg(count(labels[0]).alias("i"), count(labels[1]).alias("o"))
    rows = frames.select("camera_id", "frame_index").join(lines.select("camera_id", "line_id"), "camera_id").join(here, key, "left")
    rows = running_totals(rows, ["camera_id", "line_id"], ["frame_index"], block_of(F.col("frame_index"), FRAMES), {"entries": F.col("i"), "exits": F.col("o")})
    return rows.select(*key, "entries", "exits")


def zone_membership(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """Deduplicated rows with each region of their camera and ``inside``: foot point and three quarters of the box in its polygon.

    ``regions``: camera_id, polygon and whatever else names or sets the region, all of which stay but the polygon.
    """
    rows = dedupe_frame(obs).join(regions.withColumn("edges", G.edges(F.col("polygon"))), "camera_id")
    foot = G.in_edges(G.point(F.col("px"), F.col("py")), F.col("edges"))
    cover = G.bbox_coverage(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("polygon"))
    return rows.withColumn("inside", F.when(foot, cover >= COVERAGE - G.EPS).otherwise(F.lit(False))).drop("edges", "polygon")


def active_and_lost(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """camera_id, frame_index, active, expired (never seen again), lost (expired so far)."""
    seen = obs.select("camera_id", "frame_index", "track_id").distinct()
    active = seen.groupBy("camera_id", "frame_index").agg(F.count(F.lit(1)).alias("active"))
    last = seen.groupBy("camera_id", "track_id").agg(F.max("frame_index").alias("last"))
    number = F.col("frame_index").cast("double")
    gone = next_time(last.withColumn("then", F.col("last") + 0.5), frames.select("camera_id", number.alias("ts")), ["camera_id"], "then", "after").where("after is not null")
    gone = gone.withColumn("after", F.col("after").cast("long"))
    gone = gone.groupBy("camera_id", F.col("after").alias("frame_index")).agg(F.count(F.lit(1)).alias("expired"))
    rows = frames.select("camera_id", "frame_index").join(active, ["camera_id", "frame_index"], "left").join(gone, ["camera_id", "frame_index"], "left")
    rows = running_totals(rows, ["camera_id"], ["frame_index"], block_of(F.col("frame_index"), FRAMES), {"lost": F.col("expired")})
    return rows.select("camera_id", "frame_index", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("expired", F.lit(0)).alias("expired"), "lost")


def run_summary(obs: DataFrame, frames: DataFrame, zones: DataFrame, crossings: DataFrame) -> DataFrame:
    """One row for each camera: frames, most people at once, unique people, fullest zone, crossings."""
    people = people_per_frame(obs, frames).groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("frames"), F.max("current_people").alias("max_people"), F.max("unique_people").alias("unique_people")
    )
    fullest = zone_occupancy(obs, frames, zones).groupBy("camera_id").agg(F.max("people").alias("max_zone_people"))
    crossed = crossings.groupBy("camera_id").agg(F.count_if(F.col("direction") == "entry").alias("n_in"), F.count_if(F.col("direction") == "exit").alias("n_out"))
    rows = people.join(fullest, "camera_id", "left").join(crossed, "camera_id", "left")
    zero = F.lit(0)
    return rows.select("camera_id", "frames", "max_people", "unique_people", F.coalesce("max_zone_people", zero).alias("max_zone_people"), F.coalesce("n_in", zero).alias("entries"), F.coalesce("n_out", zero).alias("exits"))


def frame_metrics(people: DataFrame, totals: DataFrame, zones: DataFrame, restricted: DataFrame, queues: DataFrame) -> DataFrame:
    """One row for each frame: people, crossings of all lines so far, and ``told`` of zones, areas and queues.

    The last three have one row for each frame with what is to be told of it; frames of cameras
    without such a thing keep null.
    """
    key = ["camera_id", "frame_index"]
    rows = people.join(totals.groupBy(*key).agg(F.sum("entries").alias("entries"), F.sum("exits").alias("exits")), key, "left")
    for part, name in ((zones, "zones"), (restricted, "restricted"), (queues, "queues")):
        rows = rows.join(part.select(*key, F.col("told").alias(name)), key, "left")
    return rows


def collect_events(*groups: DataFrame) -> DataFrame:
    """All events of several operators; columns that a group lacks are null."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out
