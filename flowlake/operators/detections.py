"""Detections, calibration and tracking evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators.blocks import settled


def decode_detections(candidates: DataFrame, confidence: float) -> DataFrame:
    """Corner boxes from (cx, cy, w, h, score); non-finite and weak candidates are dropped."""
    finite = F.lit(True)
    for c in ("cx", "cy", "w", "h", "score"):
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = candidates.where(finite & (F.col("score") >= confidence))
    half = lambda c, s, k: F.col(c) + k * F.col(s) / 2
    return rows.withColumns({"x1": half("cx", "w", -1), "y1": half("cy", "h", -1), "x2": half("cx", "w", 1), "y2": half("cy", "h", 1)}).drop("cx", "cy", "w", "h")


def restore_letterbox(boxes: DataFrame, scale: float, pad_x: float, pad_y: float, width: int, height: int) -> DataFrame:
    """Boxes in the source frame: padding off, scale undone, clipped; boxes without area are dropped."""
    back = lambda c, pad, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), (F.col(c) - pad) / scale))
    rows = boxes.withColumns({"x1": back("x1", pad_x, width), "y1": back("y1", pad_y, height), "x2": back("x2", pad_x, width), "y2": back("y2", pad_y, height)})
    return rows.where("x2 > x1 and y2 > y1")


def overlaps(boxes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes with one box, or each with its own."""
    w = np.clip(np.minimum(boxes[:, 2], one[..., 2]) - np.maximum(boxes[:, 0], one[..., 0]), 0, None)
    h = np.clip(np.minimum(boxes[:, 3], one[..., 3]) - np.maximum(boxes[:, 1], one[..., 1]), 0, None)
    size = lambda b: np.clip(b[..., 2] - b[..., 0], 0, None) * np.clip(b[..., 3] - b[..., 1], 0, None)
    union = size(boxes) + size(one) - w * h
    return np.divide(w * h, union, out=np.zeros(len(boxes)), where=union > 0)


def kept_boxes(frame: np.ndarray, corners: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes stay, of frames that follow each other, best boxes first: each round keeps the best of every frame that has any left."""
    kept, left = [np.empty(0, int)], np.arange(len(frame))
    while len(left):
        best = np.concatenate([[True], np.diff(frame[left]) != 0])
        one = left[best]
        kept.append(one)
        left = left[~best & (overlaps(corners[left], corners[one[np.cumsum(best) - 1]]) <= threshold)]
    return np.sort(np.concatenate(kept))


def first_rows(rows: pa.Table, key: Sequence[str]) -> np.ndarray:
    """Whether each row is the first of its frame, as far as the rows tell."""
    keys = rows.select(key).to_pandas()
    before = keys.shift()
    return ~((keys == before) | (keys.isna() & before.isna())).all(axis=1).to_numpy() | (np.arange(len(keys)) == 0)


def whole_frames(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole frames: the last frame of a batch is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
        last = int(np.flatnonzero(first_rows(edge, key))[-1]) - bool(held)  # where the batch's last frame begins; -1: before it
        if last >= 0:
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def suppress_overlaps(boxes: DataFrame, threshold: float, key: tuple[str, ...] = ("camera_id", "frame_index")) -> DataFrame:
    """Greedy suppression in each frame: the best box stays, those that overlap it more than the threshold go.

    A task reads its frames sorted, works on all frames of a batch at once and carries the last one over.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_frames(batches, key):
            corners = np.stack([rows[c].to_pandas().to_numpy(float) for c in ("x1", "y1", "x2", "y2")], axis=1)
            yield from rows.take(pa.array(kept_boxes(np.cumsum(first_rows(rows, key)), corners, threshold))).to_batches()

    score = F.when(~F.isnan("score"), F.col("score")).desc_nulls_last()
    return boxes.repartition(*key).sortWithinPartitions(*key, score, "box_id").mapInArrow(keep, boxes.schema)


def person_filter(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("class_id") == 0) & (F.col("class_name").isNull() | (F.lower("class_name") == "person")))


def check_detections(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``problem``: zero_area or outside_frame (a pixel of slack), else null."""
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    out = (F.col("x1") < -1) | (F.col("y1") < -1) | (F.col("x2") > width + 1) | (F.col("y2") > height + 1)
    return boxes.withColumn("problem", F.when(flat, "zero_area").when(out, "outside_frame"))


def stride_sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("source_index") % n == 0)


def slot_sample(frames: DataFrame, interval: float) -> DataFrame:
    """The first frame in each slot of a grid that begins with the camera's first frame."""
    camera = Window.partitionBy("camera_id")
    rows = frames.withColumn("slot", F.floor((F.col("ts") - F.min("ts").over(camera)) / interval))
    first = Window.partitionBy("camera_id", "slot").orderBy("ts")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def validate_polygons(zones: DataFrame) -> DataFrame:
    """zone_id and problem, one row for each kind of fault of a polygon; none for a good one."""
    e = zones.select("zone_id", "polygon", F.posexplode_outer(G.edges(F.col("polygon"))).alias("at", "e"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    odd = zones.where((F.size("polygon") >= 3) & ~F.forall("polygon", lambda p: finite(p["x"]) & finite(p["y"]))).select("zone_id", F.lit("not_finite").alias("problem"))
    few = zones.where(F.size("polygon") < 3).select("zone_id", F.lit("too_few_points").alias("problem"))
    flat = zones.where((F.size("polygon") >= 3) & (G.polygon_area(F.col("polygon")) <= G.EPS)).select("zone_id", F.lit("no_area").alias("problem"))
    short = e.where(G.length(F.col("e.a"), F.col("e.b")) <= G.EPS).select("zone_id", F.lit("edge_without_length").alias("problem"))
    a, b = e.alias("a"), e.alias("b")
    apart = (F.col("b.at") - F.col("a.at") >= 2) & ~((F.col("a.at") == 0) & (F.col("b.at") == F.size("a.polygon") - 1))
    crossed = a.join(b, (F.col("a.zone_id") == F.col("b.zone_id")) & apart).where(G.meeting_point(F.col("a.e.a"), F.col("a.e.b"), F.col("b.e.a"), F.col("b.e.b")).isNotNull())
    crossed = crossed.select(F.col("a.zone_id").alias("zone_id"), F.lit("crosses_itself").alias("problem"))
    return few.union(odd).union(flat).union(short).union(crossed).distinct()


def fit_homographies(points: DataFrame, residual: float = 1e-5) -> DataFrame:
    """camera_id, homography (nine numbers) or reason, from four or more (ix, iy, gx, gy) each."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        camera, p = pdf["camera_id"].iloc[0], pdf[["ix", "iy", "gx", "gy"]].to_numpy(float)
        fail = lambda why: pd.DataFrame({"camera_id": [camera], "homography": [None], "reason": [why]})
        if len(p) < 4:
            return fail("fewer than four pairs")
        x, y, u, v = p.T
        zero, one = np.zeros(len(p)), np.ones(len(p))
        system = np.vstack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
        if np.linalg.matrix_rank(system) < 8:
            return fail("points are degenerate")
        h = np.linalg.svd(system)[2][-1]
        h = h / h[8] if abs(h[8]) > 1e-12 else h
        ground = np.stack([x, y, one], 1) @ h.reshape(3, 3).T
        far = np.abs(ground[:, :2] / ground[:, 2:] - p[:, 2:]).max()
        return fail("residual too large") if not far <= residual else pd.DataFrame({"camera_id": [camera], "homography": [h.tolist()], "reason": [None]})

    return points.groupBy("camera_id").applyInPandas(fit, "camera_id long, homography array<double>, reason string")


def check_ground_distance(pairs: DataFrame, homography: Column) -> DataFrame:
    """measured, absolute_error and relative_error of surveyed (ax, ay, bx, by, known) pairs."""
    rows = pairs.withColumns({"a": G.project(F.col("ax"), F.col("ay"), homography), "b": G.project(F.col("bx"), F.col("by"), homography)})
    rows = rows.withColumn("measured", G.length(F.col("a"), F.col("b"))).drop("a", "b")
    error = F.abs(F.col("measured") - F.col("known"))
    return rows.withColumns({"absolute_error": error, "relative_error": F.try_divide(error, F.col("known"))})


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a matching of least cost (Hungarian method with potentials); rows are no more than columns."""
    n, m = cost.shape
    if cost.size <= SMALL:
        return assign_small(cost.tolist(), n, m)
    row_pot, col_pot, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, done = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            reduced = cost[match[j] - 1] - row_pot[match[j]] - col_pot[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            free = np.where(done, np.inf, least)
            nxt = int(free.argmin())
            step = free[nxt]
            row_pot[match[done]] += step
            col_pot[done] -= step
            least[~done] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def assign_small(cost: list[list[float]], n: int, m: int) -> list[tuple[int, int]]:
    """The same steps by plain numbers, which for a few boxes are faster than arrays."""
    row_pot, col_pot, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j, least, done = i, 0, [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            done[j] = True
            at = match[j]
            row, pot, nxt, step = cost[at - 1], row_pot[at], 0, float("inf")
            for k in range(1, m + 1):
                if not done[k]:
                    reduced = row[k - 1] - pot - col_pot[k]
                    if reduced < least[k]:
                        least[k], way[k] = reduced, j
                    if least[k] < step:
                        nxt, step = k, least[k]
            for k in range(m + 1):
                if done[k]:
                    row_pot[match[k]] += step
                    col_pot[k] -= step
                else:
                    least[k] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def candidate_pairs(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Overlapping boxes of a frame: key, gt_id, hyp_id, iou."""
    box = F.struct("x1", "y1", "x2", "y2")
    t = truth.select("camera_id", "frame_index", F.col("track_id").alias("gt_id"), box.alias("g"))
    h = found.select("camera_id", "frame_index", F.col("track_id").alias("hyp_id"), box.alias("h"))
    rows = t.join(h, ["camera_id", "frame_index"]).withColumn("iou", G.iou(F.col("g"), F.col("h")))
    return rows.where(F.col("iou") >= least).drop("g", "h")


SMALL = 400  # entries of a cost table that is worked on by plain numbers


def chosen(gt: list, hyp: list, iou: list[float]) -> list[bool]:
    """Which candidate pairs of one frame are in the one-to-one matching of most overlap."""
    g, h = ({v: k for k, v in enumerate(sorted(set(ids)))} for ids in (gt, hyp))
    if len(g) == len(gt) and len(h) == len(hyp):
        return [True] * len(gt)
    cost = np.full((len(g), len(h)), 1e5)
    at = [(g[a], h[b]) for a, b in zip(gt, hyp)]
    for (i, j), o in zip(at, iou):
        cost[i, j] = 1 - o
    kept = set(assign(cost) if len(g) <= len(h) else [(i, j) for j, i in assign(cost.T)])
    return [pair in kept for pair in at]


def matched_levels(frame: np.ndarray, gt: np.ndarray, hyp: np.ndarray, iou: np.ndarray, levels: list[float]) -> np.ndarray:
    """Whether each candidate pair (sorted by frame, gt, hyp) is matched at each level (pairs x levels).

    A pair whose both boxes have no other candidate at the lowest level is matched as it is; the rest
    of a frame goes to the assignment. A level that leaves a frame's candidates as they were keeps
    their matching.
    """
    found = iou[:, None] >= np.array(levels)
    alone = lambda ids: pd.DataFrame({"f": frame, "i": ids}).groupby(["f", "i"], sort=False)["f"].transform("size").to_numpy() == 1
    open_ = np.flatnonzero(~(alone(gt) & alone(hyp)))
    ends = np.flatnonzero(np.diff(frame[open_])) + 1
    for rows in np.split(open_, ends) if len(open_) else []:
        g, h, o = gt[rows].tolist(), hyp[rows].tolist(), iou[rows].tolist()
        before, kept = None, []
        for k, level in enumerate(levels):
            here = [at for at, v in enumerate(o) if v >= level]
            if here != before:
                picked = chosen([g[at] for at in here], [h[at] for at in here], [o[at] for at in here])
                before, kept = here, [at for at, yes in zip(here, picked) if yes]
            found[rows, k] = False
            found[rows[kept], k] = True
    return found


def match_alphas(pairs: DataFrame, levels: list[float]) -> DataFrame:
    """The pairs with ``alphas``: the overlap thresholds at which they are in their frame's matching; only pairs that have any.

    A task reads its frames sorted, takes all frames of a batch in one call and carries the last one over.
    """
    levels, key = sorted(levels), ("camera_id", "frame_index")
    rows = pairs.where(F.col("iou") >= levels[0])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_frames(batches, key):
            found = matched_levels(np.cumsum(first_rows(table, key)), *(table[c].to_numpy() for c in ("gt_id", "hyp_id", "iou")), levels)
            any_ = np.flatnonzero(found.any(axis=1))
            ends = np.concatenate([[0], found[any_].sum(axis=1).cumsum()])
            alphas = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(levels)[np.nonzero(found[any_])[1]], pa.float64()))
            yield from table.take(pa.array(any_)).append_column("alphas", alphas).to_batches()

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.repartition(*key).sortWithinPartitions(*key, "gt_id", "hyp_id").mapInArrow(solve, f"{fields}, alphas array<double>")


def match_levels(pairs: DataFrame, levels: list[float]) -> DataFrame:
    """``match_frames`` at each overlap threshold: the pairs with ``alpha``."""
    return match_alphas(pairs, levels).select(*pairs.columns, F.explode("alphas").alias("alpha"))


def match_frames(pairs: DataFrame, least: float) -> DataFrame:
    """The one-to-one matching of most overlap in each frame."""
    return match_alphas(pairs, [least]).drop("alphas")


def sizes(truth: DataFrame, found: DataFrame) -> DataFrame:
    """camera_id, gt, hyp: boxes of each sequence, also of those that only one side has."""
    n = lambda f, name: f.groupBy("camera_id").agg(F.count(F.lit(1)).alias(name))
    return n(truth, "gt").join(n(found, "hyp"), "camera_id", "full_outer").fillna(0)


def clear_metrics(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """One row for each camera: tp, fp, fn, id_switches, fragments, precision, recall, mota."""
    rows = sizes(truth, found).join(matched.groupBy("camera_id").agg(F.count(F.lit(1)).alias("tp")), "camera_id", "left")
    rows = rows.join(id_switches(matched), "camera_id", "left").join(fragmentation(truth, matched), "camera_id", "left").fillna(0)
    rows = rows.withColumns({"fp": F.col("hyp") - F.col("tp"), "fn": F.col("gt") - F.col("tp")})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "precision": share(F.col("tp"), F.col("hyp")), "recall": share(F.col("tp"), F.col("gt")),
            "mota": F.when(F.col("gt") > 0, 1 - (F.col("fn") + F.col("fp") + F.col("id_switches")) / F.col("gt")).otherwise(F.lit(0.0)),
        }
    )


def id_switches(matched: DataFrame) -> DataFrame:
    """Matches whose track differs from the person's last matched one."""
    before = F.lag("hyp_id").over(Window.partitionBy("camera_id", "gt_id").orderBy("frame_index"))
    return matched.withColumn("was", before).where("was <> hyp_id").groupBy("camera_id").agg(F.count(F.lit(1)).alias("id_switches"))


def fragmentation(truth: DataFrame, matched: DataFrame) -> DataFrame:
    """Times that a person was tracked, lost, and tracked again."""
    rows = truth.select("camera_id", "frame_index", F.col("track_id").alias("gt_id")).join(
        matched.select("camera_id", "frame_index", "gt_id", F.lit(1).alias("hit")), ["camera_id", "frame_index", "gt_id"], "left"
    )
    order = Window.partitionBy("camera_id", "gt_id").orderBy("frame_index")
    hit = F.coalesce("hit", F.lit(0))
    rows = rows.withColumns({"now": hit, "was": F.lag(hit).over(order), "ever": F.max(hit).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where("now = 1 and was = 0 and ever = 1").groupBy("camera_id").agg(F.count(F.lit(1)).alias("fragments"))


def idf1(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """camera_id, idf1: tracks paired greedily by how often they match."""
    counts = matched.groupBy("camera_id", "gt_id", "hyp_id").agg(F.count(F.lit(1)).alias("n"))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        total, gs, hs = 0, set(), set()
        for r in pdf.sort_values(["n", "gt_id", "hyp_id"], ascending=[False, True, True]).itertuples():
            if r.gt_id not in gs and r.hyp_id not in hs:
                gs.add(r.gt_id), hs.add(r.hyp_id)
                total += r.n
        return pd.DataFrame({"camera_id": [pdf["camera_id"].iloc[0]], "idtp": [total]})

    best = counts.groupBy("camera_id").applyInPandas(pair, "camera_id long, idtp long")
    rows = sizes(truth, found).join(best, "camera_id", "left").fillna(0)
    return rows.select("camera_id", (2 * F.col("idtp") / (F.col("gt") + F.col("hyp"))).alias("idf1"))


def hota(truth: DataFrame, found: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """camera_id, hota, det_a, ass_a: means over the overlap thresholds."""
    alphas = alphas or [k / 20 for k in range(1, 20)]
    matched = match_alphas(candidate_pairs(truth, found, min(alphas)), alphas)
    n = lambda f, *by: f.groupBy("camera_id", *by).agg(F.count(F.lit(1)).alias("n"))
    hits = matched.groupBy("camera_id", "gt_id", "hyp_id").agg(*[F.count_if(F.array_contains("alphas", a)).alias(f"tp{k}") for k, a in enumerate(alphas)])
    level = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"tp{k}").alias("tp")) for k, a in enumerate(alphas)])
    tp = hits.select("camera_id", "gt_id", "hyp_id", F.inline(level)).where("tp > 0")
    g, h = n(truth, "track_id").withColumnsRenamed({"track_id": "gt_id", "n": "g"}), n(found, "track_id").withColumnsRenamed({"track_id": "hyp_id", "n": "h"})
    ass = tp.join(g, ["camera_id", "gt_id"]).join(h, ["camera_id", "hyp_id"]).withColumn("a", F.col("tp") / (F.col("g") + F.col("h") - F.col("tp")))
    ass = ass.groupBy("camera_id", "alpha").agg(F.sum("tp").alias("tp"), F.avg("a").alias("ass_a"))  # each pair of tracks weighs alike
    spine = sizes(truth, found).select("*", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    rows = spine.join(ass, ["camera_id", "alpha"], "left").fillna(0)
    rows = rows.withColumn("det_a", F.col("tp") / (F.col("gt") + F.col("hyp") - F.col("tp")))
    rows = rows.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a")))
    return rows.groupBy("camera_id").agg(*[F.avg(c).alias(c) for c in ("hota", "det_a", "ass_a")])


def compare_trackers(truth: DataFrame, trackers: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """All measures of each tracker, one row for each camera and tracker. Boxes and matches, which all measures go on from, are settled."""
    out, truth = None, settled(truth)
    for name, found in trackers.items():
        found = settled(found)
        matched = settled(match_frames(candidate_pairs(truth, found, least), least))
        rows = clear_metrics(truth, found, matched).join(idf1(truth, found, matched), "camera_id").join(hota(truth, found), "camera_id").withColumn("tracker", F.lit(name))
        out = rows if out is None else out.union(rows)
    return out
