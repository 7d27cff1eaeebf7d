"""Speed, trajectories, queues, rows of people and re-identification over tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.functions.geometry import EPS
from flowlake.operators import steps
from flowlake.operators.blocks import TEN, block_of, last_known, moving_levels, next_time, running_totals, settled
from flowlake.operators.people import dedupe_frame, zone_membership

SPEED = "camera_id long, track_id long, frame_index long, ts double, px double, py double, speed_px double, speed_m double, reason string, vx double, vy double, gvx double, gvy double, at_x double, at_y double, judged double"


def speed(obs: DataFrame, homography: Column | None, window: float = 3.0, least: float = 2.0, most_px: float = 60.0, most_m: float = 12.0) -> DataFrame:
    """Speeds of every confirmed sample, from the accepted samples of its track.

    A task reads its tracks sorted and carries the accepted samples of the last ``window`` seconds of one
    track, however long it is. ``gvx``, ``gvy``: velocity in metres; ``at_x``, ``at_y``: the last accepted
    place on the ground; ``judged``: the speed that queues judge by. ``homography`` may be a column of
    ``obs``, null where a camera has none.
    """
    rows = dedupe_frame(obs)
    g = G.project(F.col("px"), F.col("py"), homography) if homography is not None else F.lit(None).cast("struct<x:double,y:double>")
    rows = rows.withColumn("g", g).select("camera_id", "track_id", "frame_index", "ts", "px", "py", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, state, before = None, {}, None
        for pdf in batches:
            found = []
            place = [None if v != v else v for v in pdf["gx"].tolist()], [None if v != v else v for v in pdf["gy"].tolist()]
            for c, t, ts, x, y, gx, gy in zip(*(pdf[k].tolist() for k in ("camera_id", "track_id", "ts", "px", "py")), *place):
                if (c, t) != track:
                    track, state, before = (c, t), {}, None
                s = steps.speed_step(state, ts, x, y, gx, gy, window, least, most_px, most_m)
                found.append((s["px"], s["m"], s["reason"], s["vx"], s["vy"], *steps.ground_velocity(state, s), *steps.place_on_ground(state), steps.queue_speed(s, before, (ts, x, y))))
                before = (ts, x, y)
            out = pdf[["camera_id", "track_id", "frame_index", "ts", "px", "py"]].reset_index(drop=True)
            new = pd.DataFrame(found, columns=["speed_px", "speed_m", "reason", "vx", "vy", "gvx", "gvy", "at_x", "at_y", "judged"])
            yield pd.concat([out, new.astype({c: "float64" for c in new.columns if c != "reason"})], axis=1)

    return rows.repartition("camera_id", "track_id").sortWithinPartitions("camera_id", "track_id", "ts", "frame_index").mapInPandas(carry, SPEED)


def speed_summary(speeds: DataFrame) -> DataFrame:
    """camera_id, frame_index, mean_px, mean_m over the tracks that have one."""
    return speeds.groupBy("camera_id", "frame_index").agg(F.avg("speed_px").alias("mean_px"), F.avg("speed_m").alias("mean_m"))


def queue_progress(speeds: DataFrame, service: tuple[float, float] | Column, ground: Column | None = None) -> DataFrame:
    """camera_id, track_id, frame_index, progress and progress_m: pixels and metres a second toward the service point.

    ``ground``: the service point in metres (a struct of x and y), null where it has none.
    """
    sx, sy = (service["x"], service["y"]) if isinstance(service, Column) else (F.lit(float(v)) for v in service)
    pixels = G.progress(F.col("vx"), F.col("vy"), F.col("px"), F.col("py"), sx, sy)
    ground = F.lit(None).cast("struct<x:double,y:double>") if ground is None else ground
    metres = G.progress(F.col("gvx"), F.col("gvy"), F.col("at_x"), F.col("at_y"), ground["x"], ground["y"])
    return speeds.select("camera_id", "track_id", "frame_index", pixels.alias("progress"), metres.alias("progress_m"))


def ema_trajectory(obs: DataFrame, alpha: float = 0.35, history: int = 30) -> DataFrame:
    """Smoothed foot points of each track, with how many of its last ``history`` there are.

    Levels are composed from blocks of ten minutes, so that no track is folded whole.
    """
    track = ["camera_id", "track_id"]
    rows = dedupe_frame(obs).select(*track, "ts", "arrival", "frame_index", "px", "py")
    smooth = moving_levels(rows, track, ["ts", "arrival"], block_of(F.col("ts"), TEN), {"sx": F.col("px"), "sy": F.col("py")}, F.lit(alpha))
    recent = Window.partitionBy(*track).orderBy("ts").rowsBetween(1 - history, 0)
    return smooth.select(*track, "frame_index", "ts", "sx", "sy", F.count(F.lit(1)).over(recent).alias("n_history"))


def throttle(obs: DataFrame, gap: float) -> DataFrame:
    """The frames of each camera that come ``gap`` or more after the last one kept."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        pdf = pdf.sort_values("ts")
        return pdf[[steps.throttle_step(state, t, gap) for t in pdf["ts"]]]

    frames = obs.select("camera_id", "frame_index", "ts").distinct()
    return frames.groupBy("camera_id").applyInPandas(fold, "camera_id long, frame_index long, ts double")


def queue_samples(obs: DataFrame, frames: DataFrame, queues: DataFrame, speeds: DataFrame | None = None) -> DataFrame:
    """Every sample that qualifies for a queue, with its visit.

    Speed is ``judged`` of ``speeds`` (the windowed speed, else the velocity's, else that of the last two
    samples), or without ``speeds`` that of the last two samples; a sample without any qualifies.
    """
    who = ["camera_id", "queue_id", "track_id"]
    track = Window.partitionBy(*who).orderBy("ts")
    rows = zone_membership(obs, queues)
    measures = ["judged", "speed_m", "vx", "vy", "gvx", "gvy", "at_x", "at_y"]
    if speeds is None:
        rows = rows.withColumn("b", F.lag(F.struct("ts", "px", "py")).over(track))
        far = F.sqrt((F.col("px") - F.col("b.px")) * (F.col("px") - F.col("b.px")) + (F.col("py") - F.col("b.py")) * (F.col("py") - F.col("b.py")))
        rows = rows.withColumn("judged", F.try_divide(far, F.col("ts") - F.col("b.ts")))  # none between frames of one time
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in measures[1:]})
    else:
        known = speeds.select("camera_id", "track_id", "frame_index", *measures)
        rows = rows.join(known, ["camera_id", "track_id", "frame_index"], "left")
    rows = rows.withColumn("good", F.col("inside") & F.coalesce(F.col("judged") <= F.col("max_speed") + EPS, F.lit(True)))
    rows = rows.withColumn("due", F.col("ts") + F.col("gap") + 2 * EPS + EPS)
    rows = next_time(rows, frames, ["camera_id"], "due", "late")
    rows = rows.withColumns({"next_ts": F.lead("ts").over(track), "next_good": F.lead("good").over(track), "next_in": F.lead("inside").over(track), "nx": F.lead("px").over(track), "ny": F.lead("py").over(track)})
    lapsed = F.col("late").isNotNull() & (F.col("next_ts").isNull() | (F.col("late") < F.col("next_ts")))
    seen_out = F.col("next_ts").isNotNull() & ~F.col("next_good")
    rows = rows.where("good").withColumns(
        {
            "left_at": F.when(lapsed, F.col("late")).when(seen_out, F.col("next_ts")),
            "reason": F.when(lapsed, "tracking_gap").when(seen_out, F.when(F.col("next_in"), "speed_exceeded").otherwise("outside_polygon")),
            "ex": F.when(lapsed, F.col("px")).otherwise(F.col("nx")),
            "ey": F.when(lapsed, F.col("py")).otherwise(F.col("ny")),
        }
    )
    earlier = track.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("visit", F.coalesce(F.sum(F.col("left_at").isNotNull().cast("int")).over(earlier), F.lit(0)))
    return rows.withColumn("since", F.min("ts").over(Window.partitionBy(*who, "visit")))


def queue_visits(obs: DataFrame, frames: DataFrame, queues: DataFrame, size: tuple[int, int], speeds: DataFrame | None = None) -> DataFrame:
    """One row for each visit: camera_id, queue_id, track_id, since, joined_at, left_at, reason, waiting, completed.

    ``queues``: camera_id, queue_id, polygon, dwell, max_speed, gap, service (a normalised point), radius.
    A visit is a run of qualifying samples (in the region and slow); it ends with the first sample
    that doesn't qualify, or with the first frame of the camera more than ``gap`` after the last.
    """
    return visits_of(queue_samples(obs, frames, queues, speeds), size)


def visits_of(rows: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The visits of ``queue_samples``."""
    who = ["camera_id", "queue_id", "track_id"]
    joined = F.min(F.when(F.col("ts") - F.col("since") >= F.col("dwell") - EPS, F.col("ts")))
    last = rows.groupBy(*who, "visit", "since").agg(
        joined.alias("joined_at"), F.max("left_at").alias("left_at"), F.max("reason").alias("reason"),
        F.max(F.struct("ts", "ex", "ey")).alias("e"), F.first("service").alias("service"), F.first("radius").alias("radius"),
    )
    done = G.near_service(F.col("e.ex"), F.col("e.ey"), F.col("service.x"), F.col("service.y"), *size, F.col("radius"))
    has = F.col("joined_at").isNotNull() & F.col("left_at").isNotNull()
    return last.select(
        *who, "since", "joined_at", "left_at", "reason",
        F.when(has, F.greatest(F.lit(0.0), F.col("left_at") - F.col("since"))).alias("waiting"), F.when(has, done).alias("completed"),
    )


UNIT = 1_000_000  # speeds are summed in whole millionths, so that running sums are exact


def member_measures(samples: DataFrame, size: tuple[int, int]) -> DataFrame:
    """camera_id, queue_id, ts, kind, n, v: changes of how many members have a measure, and of its sum in millionths.

    Kinds: speed_px, speed_m, progress_px, progress_m. A member's measures are those of its last
    qualifying sample, from joining to leaving.
    """
    w, h = (float(max(n - 1, 1)) for n in size)
    homography = F.col("homography") if "homography" in samples.columns else F.lit(None).cast("array<double>")
    rows = samples.withColumns({"sx": F.col("service.x") * w, "sy": F.col("service.y") * h, "h": homography})
    sg = G.project(F.col("sx"), F.col("sy"), F.col("h"))
    values = {
        "speed_px": F.col("judged"), "speed_m": F.col("speed_m"), "progress_px": G.progress(F.col("vx"), F.col("vy"), F.col("px"), F.col("py"), F.col("sx"), F.col("sy")),
        "progress_m": G.progress(F.col("gvx"), F.col("gvy"), F.col("at_x"), F.col("at_y"), sg["x"], sg["y"]),
    }
    key = ["camera_id", "queue_id"]
    visit = Window.partitionBy(*key, "track_id", "visit").orderBy("ts")
    ripe = F.col("ts") - F.col("since") >= F.col("dwell") - EPS
    rows = rows.where(ripe).withColumn("until", F.coalesce("left_at", F.lead("ts").over(visit)))
    spans = rows.select(*key, "ts", "until", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.rint(v * UNIT).cast("long"))])).alias("kind", "v")).where("v is not null")
    change = lambda t, sign: F.struct(F.col(t).alias("ts"), F.lit(sign).cast("long").alias("n"), (F.lit(sign) * F.col("v")).alias("v"))
    return spans.select(*key, "kind", F.inline(F.array(change("ts", 1), change("until", -1)))).where("ts is not null")


def queue_status(visits: DataFrame, frames: DataFrame, queues: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Each queue at each frame: raw_count, smoothed_count, present, overflow, mean_wait, completed, mean_completed, last_wait.

    ``queues``: camera_id, queue_id, alpha (of the smoothing), overflow (the count from which it is too long).
    With ``measures`` (``member_measures``) also the means over members: speed_px, speed_m, progress_px,
    progress_m, exact to a millionth. Totals and levels are carried over blocks of the clock.
    """
    key = ["camera_id", "queue_id"]
    joined, zero, none = visits.where("joined_at is not null"), F.lit(0), F.lit(None)
    done = F.coalesce(F.col("completed").cast("int"), zero)
    wait = F.when(done == 1, F.struct("track_id", "waiting"))
    step = lambda time, n, since, d, w, last: F.struct(F.col(time).alias("ts"), n.alias("n"), since.alias("s"), d.alias("d"), w.alias("w"), last.alias("last"))
    changes = F.array(
        step("joined_at", F.lit(1), F.col("since"), zero, F.lit(0.0), none.cast("struct<track_id:bigint,waiting:double>")),
        step("left_at", F.lit(-1), -F.col("since"), done, done * F.coalesce("waiting", F.lit(0.0)), wait),
    )
    changes = joined.select(*key, F.inline(changes)).where("ts is not null").groupBy(*key, "ts").agg(*[F.sum(k).alias(k) for k in "nsdw"], F.max("last").alias("last"))
    rows = frames.select("camera_id", "frame_index", "ts").join(queues.select(*key, "alpha", F.col("overflow").alias("most")), "camera_id").join(changes, [*key, "ts"], "left")
    totals = {k: F.col(k) for k in "nsdw"}
    kinds = ["speed_px", "speed_m", "progress_px", "progress_m"] if measures is not None else []
    if measures is not None:
        known = measures.groupBy(*key, "ts").agg(*[F.sum(F.when(F.col("kind") == k, F.col(x))).alias(f"{x}_{k}") for k in kinds for x in "nv"])
        rows = rows.join(known, [*key, "ts"], "left")
        totals |= {f"{x}_{k}": F.col(f"{x}_{k}") for k in kinds for x in "nv"}
    block = block_of(F.col("ts"))
    rows = settled(running_totals(settled(rows), key, ["ts"], block, totals))
    rows = last_known(rows, key, ["ts"], block, "last", "last_done").select(
        *key, "frame_index", "ts", "alpha", F.col("n").alias("raw_count"), (F.col("n") > 0).alias("present"), (F.col("n") >= F.col("most")).alias("overflow"),
        F.when(F.col("n") > 0, (F.col("n") * F.col("ts") - F.col("s")) / F.col("n")).alias("mean_wait"),
        F.col("d").alias("completed"), F.when(F.col("d") > 0, F.col("w") / F.col("d")).alias("mean_completed"), F.col("last_done.waiting").alias("last_wait"),
        *[F.when(F.col(f"n_{k}") > 0, F.col(f"v_{k}") / F.col(f"n_{k}") / F.lit(float(UNIT))).alias(k) for k in kinds],
    )
    return moving_levels(settled(rows), key, ["ts"], block_of(F.col("ts"), TEN), {"smoothed_count": F.col("raw_count")}, F.col("alpha"), 0.0).drop("alpha")


def queue_counts(visits: DataFrame, frames: DataFrame, queues: DataFrame) -> DataFrame:
    """camera_id, queue_id, ts, raw_count and overflow of ``queue_status``, without the rest of it."""
    key = ["camera_id", "queue_id"]
    change = lambda t, n: F.struct(F.col(t).alias("ts"), F.lit(n).alias("n"))
    changes = visits.where("joined_at is not null").select(*key, F.inline(F.array(change("joined_at", 1), change("left_at", -1))))
    changes = changes.where("ts is not null").groupBy(*key, "ts").agg(F.sum("n").alias("n"))
    rows = frames.select("camera_id", "frame_index", "ts").join(queues.select(*key, F.col("overflow").alias("most")), "camera_id").join(changes, [*key, "ts"], "left")
    rows = running_totals(rows, key, ["ts"], block_of(F.col("ts")), {"n": F.col("n")})
    return rows.select(*key, "frame_index", "ts", F.col("n").alias("raw_count"), (F.col("n") >= F.col("most")).alias("overflow"))


def overflow_events(status: DataFrame) -> DataFrame:
    """camera_id, queue_id, ts, event_type, raw_count where the overflow flag flips."""
    order = Window.partitionBy("camera_id", "queue_id").orderBy("ts")
    rows = status.withColumn("was", F.lag("overflow", 1, False).over(order)).where("was <> overflow")
    return rows.select("camera_id", "queue_id", "ts", F.when(F.col("overflow"), "queue_overflow_started").otherwise("queue_overflow_ended").alias("event_type"), "raw_count")


ROWS = ["camera_id", "frame_index", "ts", "center", "top", "bottom", "track_ids", "mean_px", "mean_m"]


def vertical_rows(obs: DataFrame, width: float, distance: float = 0.08, least: int = 2, speeds: DataFrame | None = None) -> DataFrame:
    """Rows of people under each other: camera_id, frame_index, ts, center, top, bottom, track_ids, mean_px, mean_m.

    A task reads sorted frames, of blocks of a camera's clock, and carries the people of one frame. The
    means are over the row's people whose speed is known (``speeds``); null without any.
    """
    frame = ["camera_id", "frame_index"]
    people = dedupe_frame(obs).select(*frame, "ts", ((F.col("x1") + F.col("x2")) / 2).alias("x"), "track_id", "y1", "y2")
    if speeds is None:
        people = people.withColumns({"speed_px": F.lit(None).cast("double"), "speed_m": F.lit(None).cast("double")})
    else:
        people = people.join(speeds.select(*frame, "track_id", "speed_px", "speed_m"), [*frame, "track_id"], "left")
    names = ["camera_id", "frame_index", "ts", "x", "track_id", "y1", "y2", "speed_px", "speed_m"]

    def mean(values: list) -> float | None:
        known = [v for v in values if v is not None and v == v]
        return sum(known) / len(known) if known else None

    def told(key: tuple, people: list[tuple]) -> list[tuple]:
        found = steps.rows_of(people, distance * width, least)
        return [(*key, sum(p[0] for p in c) / len(c), min(p[2] for p in c), max(p[3] for p in c), sorted(p[1] for p in c), mean([p[4] for p in c]), mean([p[5] for p in c])) for c in found]

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            out = []
            for camera, number, ts, *person in zip(*(pdf[k].tolist() for k in names)):
                if (camera, number, ts) != key:
                    out += told(key, held) if held else []
                    key, held = (camera, number, ts), []
                held.append(tuple(person))
            yield pd.DataFrame(out, columns=ROWS)
        if held:
            yield pd.DataFrame(told(key, held), columns=ROWS)

    block = F.floor(F.col("frame_index") / 4096)
    dealt = people.select(*names).repartition("camera_id", block).sortWithinPartitions(*frame, "x", "track_id")
    return dealt.mapInPandas(carry, "camera_id long, frame_index long, ts double, center double, top double, bottom double, track_ids array<long>, mean_px double, mean_m double")


def stable_row_ids(rows: DataFrame, frames: DataFrame, width: float, distance: float = 0.12) -> DataFrame:
    """The rows with ``row_id``, kept while a row is found again in the camera's next frame.

    Ids depend on all frames before, so a camera's frames are read in order by one task, which carries
    the last frame's rows and the next id only.
    """
    spine = frames.select("camera_id", "frame_index").join(rows.select("camera_id", "frame_index", "center"), ["camera_id", "frame_index"], "left")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, number, state, centers = None, None, {}, []

        def told() -> list[tuple]:
            return [(camera, number, c, i) for c, i in zip(centers, steps.row_step(state, centers, distance * width))]

        for pdf in batches:
            out = []
            for c, n, center in zip(pdf["camera_id"].tolist(), pdf["frame_index"].tolist(), pdf["center"].tolist()):
                if (c, n) != (camera, number):
                    out += told() if camera is not None else []
                    state = state if c == camera else {}
                    camera, number, centers = c, n, []
                if center == center and center is not None:
                    centers.append(center)
            yield pd.DataFrame(out, columns=["camera_id", "frame_index", "center", "row_id"]).astype({"row_id": "int64"})
        if camera is not None:
            yield pd.DataFrame(told(), columns=["camera_id", "frame_index", "center", "row_id"]).astype({"row_id": "int64"})

    return spine.repartition("camera_id").sortWithinPartitions("camera_id", "frame_index", "center").mapInPandas(carry, "camera_id long, frame_index long, center double, row_id long")


def normalize_embedding(vector: Column) -> Column:
    """Unit length; null when the length is nearly 0 or not finite."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return G.let(norm, lambda n: F.when((n > 1e-12) & (n < float("inf")), F.transform(vector, lambda x: x.cast("double") / n)))


def gallery_prototypes(vectors: DataFrame, keep: float = 0.8) -> DataFrame:
    """track_id, vector, last_seen: prototypes blended in frame order, unit length after each step.

    A task reads its tracks sorted and carries one prototype, however long a track is; of several
    vectors of one track and frame the smaller goes first. Rows without a track, and vectors without a usable length, take no part.
    """

    def blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, prototype, seen = None, None, None
        table = lambda rows: pd.DataFrame(rows, columns=["track_id", "vector", "last_seen"])
        for pdf in batches:
            done = []
            for t, frame, vector in zip(pdf["track_id"], pdf["frame"], pdf["vector"]):
                unit = np.asarray(vector, np.float64)
                unit = unit / np.linalg.norm(unit)
                if t == track:
                    prototype = keep * prototype + (1 - keep) * unit
                    prototype /= np.linalg.norm(prototype)
                else:
                    if track is not None:
                        done.append((track, prototype.tolist(), seen))
                    track, prototype = t, unit
                seen = frame
            yield table(done)
        if track is not None:
            yield table([(track, prototype.tolist(), seen)])

    usable = vectors.where(F.col("track_id").isNotNull() & normalize_embedding(F.col("vector")).isNotNull()).select("track_id", "frame", "vector")
    return usable.repartition("track_id").sortWithinPartitions("track_id", "frame", "vector").mapInPandas(blend, "track_id long, vector array<double>, last_seen long")


MATCHED = 2048  # rows of a block of queries or of the gallery
AGES = 64


def gallery_match(queries: DataFrame, gallery: DataFrame, threshold: float, max_age: int, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, track_id, score: the most similar track that is young enough, or null.

    The gallery has one row for each known track. It is cut into at most ``AGES`` ranges of last_seen, and
    these into blocks; a query goes to the blocks of the ranges that can be young enough for it, with
    others of its block, as one matrix product. Of equal scores the larger track_id wins.
    """
    known = (gallery if excluded is None else gallery.join(excluded, "track_id", "left_anti")).select("track_id", F.col("vector").alias("g"), "last_seen")
    unit = queries.withColumn("q", normalize_embedding(F.col("vector"))).where("q is not null").select("query_id", "frame", "q")
    n, most = known.count(), queries.count()
    ends = sorted(set(known.approxQuantile("last_seen", [k / AGES for k in range(1, AGES)], 0.01))) if n > MATCHED else []
    age = lambda seen: F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < seen)) if ends else F.lit(0)
    fullest = known.groupBy(age(F.col("last_seen")).alias("age")).count().agg(F.max("count")).first()[0] or 1
    parts, blocks = -(-fullest // MATCHED), max(-(-most // MATCHED), 1)
    part = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    each = lambda low, high: F.explode(F.sequence(low, high))
    left = unit.select("*", part("query_id", blocks).alias("block"), each(age(F.col("frame") - max_age), F.lit(len(ends))).alias("age"))
    left = left.select("*", each(F.lit(0), F.lit(parts - 1)).alias("part"))
    right = known.select("*", age(F.col("last_seen")).alias("age"), part("track_id", parts).alias("part"), each(F.lit(0), F.lit(blocks - 1)).alias("block"))

    def best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "track_id": pd.Series(dtype="int64")})
        g = g.sort_values("track_id", ascending=False)
        scores = np.stack(q["q"].to_numpy()) @ np.stack(g["g"].to_numpy()).T
        old = q["frame"].to_numpy()[:, None] - g["last_seen"].to_numpy()[None, :] > max_age
        scores[old] = -np.inf
        at = scores.argmax(axis=1)
        top = scores[np.arange(len(q)), at]
        found = pd.DataFrame({"query_id": q["query_id"].to_numpy(), "score": top, "track_id": g["track_id"].to_numpy()[at]})
        return found[top > -np.inf]

    key = ["block", "age", "part"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "query_id long, score double, track_id long")
    found = pairs.groupBy("query_id").agg(F.max(F.struct("score", "track_id")).alias("b")).where(F.col("b.score") >= threshold)
    rows = queries.select("query_id").join(found, "query_id", "left")
    return rows.select("query_id", F.col("b.track_id").alias("track_id"), F.col("b.score").alias("score"))
