"""Heatmaps as sparse cell tables: occupancy, dwell, windows, regions and smoothing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import geometry as G
from flowlake.operators.people import dedupe_frame


def with_cell(rows: DataFrame, columns: int, height: int, bounds: tuple[float, float, float, float], x: Column | None = None, y: Column | None = None) -> DataFrame:
    return rows.withColumn("cell", G.grid_cell(F.col("px") if x is None else x, F.col("py") if y is None else y, columns, height, bounds))


def occupancy(obs: DataFrame, columns: int, height: int, bounds: tuple, by: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """Confirmed samples in each cell: by, row, col, occupancy."""
    rows = with_cell(dedupe_frame(obs, confirmed_first=False).where("confirmed"), columns, height, bounds).where("cell is not null")
    return rows.groupBy(*by, "cell.row", "cell.col").agg(F.count(F.lit(1)).alias("occupancy"))


def dwell(obs: DataFrame, columns: int, height: int, bounds: tuple, max_gap: float, by: tuple[str, ...] = ("camera_id",), x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Seconds in each cell: the time to a track's next sample goes to the cell it was in.

    Longer gaps than ``max_gap`` and unconfirmed samples break the chain.
    """
    rows = with_cell(dedupe_frame(obs, confirmed_first=False), columns, height, bounds, x, y)
    track = Window.partitionBy(*by, "track_id").orderBy("ts")
    rows = rows.withColumns({"next_ts": F.lead("ts").over(track), "next_ok": F.lead("confirmed").over(track)})
    gap = F.col("next_ts") - F.col("ts")
    kept = rows.where(F.col("confirmed") & F.col("next_ok") & (gap > 0) & (gap <= max_gap) & F.col("cell").isNotNull())
    return kept.groupBy(*by, "cell.row", "cell.col").agg(F.sum(gap).alias("dwell_seconds"))


def window_starts(times: DataFrame, window: float) -> DataFrame:
    """camera_id, ts, window_start: tumbling windows that each begin with the first frame at or after the last one's end.

    A fold over a camera's distinct frame times, one at a time.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        start, out = None, []
        for t in pdf["ts"].sort_values():
            if start is None or t >= start + window:
                start = t
            out.append((pdf["camera_id"].iloc[0], t, start))
        return pd.DataFrame(out, columns=["camera_id", "ts", "window_start"])

    return times.select("camera_id", "ts").distinct().groupBy("camera_id").applyInPandas(fold, "camera_id long, ts double, window_start double")


def windowed(obs: DataFrame, frames: DataFrame, window: float, columns: int, height: int, bounds: tuple, max_gap: float) -> DataFrame:
    """camera_id, window_start, row, col, occupancy, dwell_seconds; a new window forgets all tracks."""
    rows = obs.join(window_starts(frames, window), ["camera_id", "ts"])
    by = ("camera_id", "window_start")
    return occupancy(rows, columns, height, bounds, by).join(dwell(rows, columns, height, bounds, max_gap, by), [*by, "row", "col"], "left").fillna({"dwell_seconds": 0.0})


def ground(obs: DataFrame, homography: Column, columns: int, height: int, bounds: tuple, max_gap: float) -> DataFrame:
    """Occupancy and dwell on the ground plane; points that don't project have no cell."""
    rows = obs.withColumn("g", G.project(F.col("px"), F.col("py"), homography)).withColumns({"px": F.col("g.x"), "py": F.col("g.y")}).drop("g")
    occupied = occupancy(rows, columns, height, bounds)
    return occupied.join(dwell(rows, columns, height, bounds, max_gap), ["camera_id", "row", "col"], "left").fillna({"dwell_seconds": 0.0})


def crowded_regions(cells: DataFrame, columns: int, height: int, value: str = "occupancy", rows: int = 3, cols: int = 4, top: int = 3) -> DataFrame:
    """The ``top`` regions of a camera by area-weighted mean: camera_id, rank, region_id, average."""
    overlap = lambda at, n, r, parts: F.greatest(F.least(at + 1, (r + 1) * F.lit(n) / parts) - F.greatest(at, r * F.lit(n) / parts), F.lit(0.0))
    spread = cells.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    weight = overlap(F.col("row"), height, F.col("r"), rows) * overlap(F.col("col"), columns, F.col("c"), cols)
    size = height / rows * columns / cols
    means = spread.groupBy("camera_id", (F.col("r") * cols + F.col("c") + 1).alias("region_id")).agg((F.sum(weight * F.col(value)) / F.lit(size)).alias("average"))
    best = Window.partitionBy("camera_id").orderBy(F.col("average").desc(), "region_id")
    return means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("camera_id", "rank", "region_id", "average")


def region_layers(cells: DataFrame, columns: int, height: int) -> DataFrame:
    """camera_id, layer, x, y, value, intensity: means over 3 x 4 rounded slices of the grid.

    ``cells``: occupancy and dwell_seconds. Layers: occupancy, dwell (minutes), traffic (the same as
    occupancy) and congestion (percent of the fullest region).
    """
    cuts = lambda n, parts: [(round(k * n / parts), round((k + 1) * n / parts)) for k in range(parts)]
    ys, xs = cuts(height, 3), cuts(columns, 4)
    places = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(y1).alias("y1"), F.lit(y2).alias("y2"), F.lit(x1).alias("x1"), F.lit(x2).alias("x2")) for r, (y1, y2) in enumerate(ys) for c, (x1, x2) in enumerate(xs)]
    cameras = cells.groupBy("camera_id").agg(F.max("occupancy").alias("most"), (F.max("dwell_seconds") / 60).alias("longest"))
    spine = cameras.select("*", F.inline(F.array(*places)))
    put = spine.join(
        cells.withColumnRenamed("camera_id", "of"),
        (F.col("camera_id") == F.col("of")) & (F.col("row") >= F.col("y1")) & (F.col("row") < F.col("y2")) & (F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")),
        "left",
    )
    size = (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    mean = lambda c: F.when(F.first(size) > 0, F.coalesce(F.sum(c), F.lit(0)) / F.first(size)).otherwise(F.lit(0.0))
    rows = put.groupBy("camera_id", "r", "c", "most", "longest").agg(mean("occupancy").alias("o"), (mean("dwell_seconds") / 60).alias("d"))
    top = F.max("o").over(Window.partitionBy("camera_id"))
    share = lambda v, m: F.when(m > 0, v / m).otherwise(F.lit(0.0))
    rows = rows.withColumn("top", F.when(top > 0, top).otherwise(F.lit(1.0)))
    layer = lambda name, v, i: F.struct(F.lit(name).alias("layer"), v.alias("value"), i.alias("intensity"))
    o, d = F.col("o"), F.col("d")
    layers = F.array(
        layer("occupancy", o, share(o, F.col("most"))), layer("dwell", d, share(d, F.col("longest"))),
        layer("traffic", o, share(o, F.col("most"))), layer("congestion", o * 100 / F.col("top"), o / F.col("top")),
    )
    return rows.select("camera_id", ((F.col("c") + 0.5) * 25).alias("x"), ((F.col("r") + 0.5) * 100 / 3).alias("y"), F.inline(layers))


def kernel(sigma: float) -> list[float]:
    """A normalised Gaussian of odd size, wide enough for eight deviations."""
    size = round(8 * sigma + 1) | 1
    half = size // 2
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(weights) for w in weights]


def smooth(cells: DataFrame, columns: int, height: int, sigma: float, value: str = "occupancy") -> DataFrame:
    """Gaussian blur with a zero border: camera_id, row, col, smoothed, intensity (0..255).

    Two one-dimensional passes over the sparse cells, so a cell is spread along rows, then columns.
    """
    weights = kernel(sigma)
    half = len(weights) // 2
    taps = F.array(*[F.struct(F.lit(k - half).alias("step"), F.lit(w).alias("weight")) for k, w in enumerate(weights)])

    def along(frame: DataFrame, axis: str, size: int) -> DataFrame:
        other = "col" if axis == "row" else "row"
        moved = frame.select("camera_id", other, axis, "v", F.inline(taps)).withColumn(axis, F.col(axis) + F.col("step"))
        return moved.where((F.col(axis) >= 0) & (F.col(axis) < size)).groupBy("camera_id", "row", "col").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))

    rows = along(along(cells.select("camera_id", "row", "col", F.col(value).cast("double").alias("v")), "col", columns), "row", height)
    most = F.max("v").over(Window.partitionBy("camera_id"))
    return rows.select("camera_id", "row", "col", F.col("v").alias("smoothed"), F.when(most > 0, F.rint(F.col("v") / most * 255)).otherwise(0.0).cast("int").alias("intensity"))


def export_grid(cells: DataFrame, columns: int, height: int, value: str = "occupancy") -> DataFrame:
    """Dense rows for each camera: camera_id, row, line (comma-joined cells, 0 where empty)."""
    kind = "%d" if dict(cells.dtypes)[value] in ("bigint", "int") else "%.9g"
    spine = cells.select("camera_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    full = spine.join(cells, ["camera_id", "row", "col"], "left").withColumn("v", F.format_string(kind, F.coalesce(value, F.lit(0).cast(dict(cells.dtypes)[value]))))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda s: s["v"])
    return full.groupBy("camera_id", "row").agg(F.array_join(ordered, ",").alias("line"))
