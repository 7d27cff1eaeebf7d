"""Geometry and scalar rules as Columns.

A polygon is an array of struct<x,y>; an edge pairs each vertex with the one before it. Tolerances
of ``EPS`` are part of the rules. Null coordinates give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
POINT = "struct<x:double,y:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def literal_polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def denormalize(x: Column, y: Column, width: Column | float, height: Column | float) -> Column:
    """A normalised point in pixels; corners are inclusive."""
    width, height = (F.lit(v) if isinstance(v, (int, float)) else v for v in (width, height))
    return point(x * (width - 1), y * (height - 1))


def pixel_polygon(polygon: Column, width: float, height: float) -> Column:
    return F.transform(polygon, lambda p: denormalize(p["x"], p["y"], width, height))


def length(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def signed_side(p: Column, a: Column, b: Column) -> Column:
    """Cross product of the line from a to b and the point: positive to its left in screen axes."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def line_side(p: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where the line has no length."""
    band = EPS * F.greatest(F.lit(1.0), length(a, b))
    value = signed_side(p, a, b)
    side = F.when(value > band, 1).when(value < -band, -1).when(value.isNotNull(), 0)
    return F.when(length(a, b) > EPS, side)


def edges(polygon: Column) -> Column:
    """(a, b) for each vertex b and the vertex a before it."""
    before = lambda i: F.when(i == 0, F.element_at(polygon, -1)).otherwise(F.get(polygon, i - 1))
    return F.transform(polygon, lambda p, i: F.struct(before(i).alias("a"), p.alias("b")))


def on_segment(p: Column, a: Column, b: Column) -> Column:
    near = F.abs(signed_side(p, a, b)) <= EPS * F.greatest(F.lit(1.0), length(a, b))
    across = lambda k: (p[k] >= F.least(a[k], b[k]) - EPS) & (p[k] <= F.greatest(a[k], b[k]) + EPS)
    return near & across("x") & across("y")


def in_edges(p: Column, sides: Column, boundary: bool = True) -> Column:
    """Even-odd membership in a polygon given by its edges."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (a["x"] - b["x"]) * (p["y"] - b["y"]) / (a["y"] - b["y"]) + b["x"]
        return F.when((b["y"] > p["y"]) != (a["y"] > p["y"]), p["x"] < at).otherwise(F.lit(False))

    odd = F.size(F.filter(sides, crossed)) % 2 == 1
    return F.when(F.exists(sides, lambda e: on_segment(p, e["a"], e["b"])), F.lit(boundary)).otherwise(odd)


def point_in_polygon(x: Column, y: Column, polygon: Column, boundary: bool = True) -> Column:
    return let(F.struct(point(x, y).alias("p"), edges(polygon).alias("e")), lambda s: in_edges(s["p"], s["e"], boundary))


def polygon_area(polygon: Column) -> Column:
    """Unsigned shoelace area, 0 below three vertices."""
    twice = F.aggregate(edges(polygon), F.lit(0.0), lambda t, e: t + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2.0)


def clip_half(polygon: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """The part of a polygon on one side of an axis-parallel line."""
    inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)

    def meet(a: Column, b: Column) -> Column:
        t = (bound - a[axis]) / (b[axis] - a[axis])
        x = bound if axis == "x" else a["x"] + t * (b["x"] - a["x"])
        y = bound if axis == "y" else a["y"] + t * (b["y"] - a["y"])
        return point(x, y)

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        none = F.array().cast(f"array<{POINT}>")
        return (
            F.when(inside(b) & ~inside(a), F.array(meet(a, b), b))
            .when(inside(b), F.array(b))
            .when(inside(a), F.array(meet(a, b)))
            .otherwise(none)
        )

    return let(polygon, lambda p: F.when(F.size(p) == 0, p).otherwise(F.flatten(F.transform(edges(p), kept))))


def bbox_coverage(x1: Column, y1: Column, x2: Column, y2: Column, polygon: Column) -> Column:
    """The share of a box's area inside a polygon; 0 for a box without area."""
    area = F.abs(x2 - x1) * F.abs(y2 - y1)
    out = polygon
    for axis, bound, above in (("x", F.least(x1, x2), True), ("x", F.greatest(x1, x2), False), ("y", F.least(y1, y2), True), ("y", F.greatest(y1, y2), False)):
        out = clip_half(out, axis, bound, above)
    return F.when(area <= 0, F.lit(0.0)).otherwise(let(out, polygon_area) / area)


def meeting_point(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where segments ab and cd meet, ends included; null if they don't or are parallel."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    across = rx * sy - ry * sx
    qx, qy = c["x"] - a["x"], c["y"] - a["y"]
    t, u = (qx * sy - qy * sx) / across, (qx * ry - qy * rx) / across
    within = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
    return F.when(F.abs(across) > EPS, F.when(within, point(a["x"] + t * rx, a["y"] + t * ry)))


def segment_crossing(before: Column, now: Column, a: Column, b: Column) -> Column:
    """crossed, direction and place of a move across the segment ab; touching isn't crossing."""
    start, end, at = line_side(before, a, b), line_side(now, a, b), meeting_point(before, now, a, b)
    crossed = (start != 0) & (end != 0) & (start != end) & at.isNotNull()
    way = F.when(crossed, F.when(start < end, "negative_to_positive").otherwise("positive_to_negative"))
    return F.struct(F.coalesce(crossed, F.lit(False)).alias("crossed"), way.alias("direction"), F.when(crossed, at).alias("place"))


def centroid(polygon: Column) -> Column:
    """Mean of the vertices."""
    total = lambda k: F.aggregate(polygon, F.lit(0.0), lambda t, p: t + p[k])
    return F.when(F.size(polygon) > 0, point(total("x") / F.size(polygon), total("y") / F.size(polygon)))


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 when the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def foot_point(x1: Column, x2: Column, y2: Column) -> Column:
    return point((x1 + x2) / 2, y2)


def project(x: Column, y: Column, h: Column) -> Column:
    """(x, y, reason) of a point on the ground; ``h`` is a row-major 3 x 3 matrix or null."""
    row = lambda k: F.get(h, F.lit(3 * k)) * x + F.get(h, F.lit(3 * k + 1)) * y + F.get(h, F.lit(3 * k + 2))
    w = row(2)
    gx, gy = F.when(F.abs(w) > 1e-12, row(0) / w), F.when(F.abs(w) > 1e-12, row(1) / w)
    finite = ~F.isnan(gx) & ~F.isnan(gy) & (F.abs(gx) < float("inf")) & (F.abs(gy) < float("inf"))
    reason = F.when(h.isNull(), "not configured").when(F.abs(w) <= 1e-12, "projects to infinity").when(~finite, "not finite")
    return F.struct(F.when(finite, gx).alias("x"), F.when(finite, gy).alias("y"), reason.alias("reason"))


def box_ground(x1: Column, y1: Column, x2: Column, y2: Column, h: Column) -> Column:
    """A box's foot on the ground with its 2 x 2 covariance (xx, xy, yy), by the Jacobian of ``h``.

    Pixel deviations are a twentieth of the box's width and height, clipped to 2..13 and 2..10.
    Without a matrix the image plane stands for the ground. A foot on the horizon has no place (null).
    """
    u, v = (x1 + x2) / 2, y2
    clip = lambda s, top: F.greatest(F.lit(2.0), F.least(F.lit(top), F.lit(0.05) * s))
    su, sv = clip(y2 - y1, 13.0), clip(y2 - y1, 10.0)
    at = lambda k: F.coalesce(F.get(h, F.lit(k)), F.lit(float(k % 4 == 0)))
    w = at(6) * u + at(7) * v + at(8)
    w = F.when(F.abs(w) > 1e-12, w)
    gx, gy = (at(0) * u + at(1) * v + at(2)) / w, (at(3) * u + at(4) * v + at(5)) / w
    a, b, c, d = (at(0) - gx * at(6)) / w, (at(1) - gx * at(7)) / w, (at(3) - gy * at(6)) / w, (at(4) - gy * at(7)) / w
    vu, vv = su * su, sv * sv
    return F.struct(
        gx.alias("x"), gy.alias("y"), (a * a * vu + b * b * vv).alias("xx"), (a * c * vu + b * d * vv).alias("xy"), (c * c * vu + d * d * vv).alias("yy")
    )


def progress(vx: Column, vy: Column, x: Column, y: Column, sx: Column, sy: Column) -> Column:
    """Signed speed toward the service point; 0 at it, null when anything is unknown."""
    dx, dy = sx - x, sy - y
    far = F.sqrt(dx * dx + dy * dy)
    return F.when(far <= 1e-12, F.lit(0.0) * vx * vy).otherwise((vx * dx + vy * dy) / far)


def near_service(x: Column, y: Column, sx: Column, sy: Column, width: float, height: float, radius: Column | float) -> Column:
    """Whether a pixel point is within the normalised radius of a normalised service point."""
    dx, dy = x / F.lit(float(max(width - 1, 1))) - sx, y / F.lit(float(max(height - 1, 1))) - sy
    return F.sqrt(dx * dx + dy * dy) <= radius + EPS


def grid_cell(x: Column, y: Column, columns: int, rows: int, bounds: tuple[float, float, float, float]) -> Column:
    """(row, col) of a point, null outside the bounds; the far edges are inclusive."""
    x1, y1, x2, y2 = bounds

    def place(v: Column, low: float, high: float, n: int) -> Column:
        at = (v - low) / F.lit((high - low) / n)
        snapped = F.when(F.abs(at - F.rint(at)) <= EPS, F.rint(at)).otherwise(at)
        return F.least(F.floor(snapped).cast("int"), F.lit(n - 1))

    inside = (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)
    return F.when(inside, F.struct(place(y, y1, y2, rows).alias("row"), place(x, x1, x2, columns).alias("col")))


def schedule_active(ts: Column, days: Column, start_minute: Column, end_minute: Column, zone: Column) -> Column:
    """Whether a UTC timestamp lies in a weekly window of local minutes; Monday is 0.

    An overnight window belongs to the day on which it starts; the end is exclusive. Without days
    the schedule is always active.
    """
    local = F.from_utc_timestamp(ts, zone)
    minute, day = F.hour(local) * 60 + F.minute(local), F.weekday(local)
    yesterday = (day + 6) % 7
    plain = F.array_contains(days, day) & (minute >= start_minute) & (minute < end_minute)
    night = (F.array_contains(days, day) & (minute >= start_minute)) | (F.array_contains(days, yesterday) & (minute < end_minute))
    return F.when(days.isNull(), F.lit(True)).when(start_minute < end_minute, plain).otherwise(night)


def percent_change(current: Column, previous: Column) -> Column:
    """Percent by which a value grew, as a share of the signed previous value; null without one."""
    return F.when(previous.isNotNull() & (previous != 0), F.round((current - previous) * 100 / previous, 2))


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    return F.when(bottom.isNotNull() & (bottom != 0), top * scale / bottom)


def event_severity(kind: Column) -> Column:
    return F.when(kind.contains("restricted_area_confirmed"), "critical").when(kind.contains("overflow"), "warning").otherwise("info")


def event_metric_key(kind: Column) -> Column:
    return F.when(kind.contains("overflow"), "criticalMinutes").when(kind.contains("line_crossed"), "entries")


def parse_polygon(text: Column) -> Column:
    """A polygon from JSON, points as {x, y} or [x, y]; null unless three or more, all in 0..1."""
    named = F.from_json(text, f"array<{POINT}>")
    pairs = F.transform(F.from_json(text, "array<array<double>>"), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    inside = lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False))
    good = lambda poly: F.when((F.size(poly) >= 3) & F.forall(poly, lambda p: inside(p["x"]) & inside(p["y"])), poly)
    return F.coalesce(good(named), good(pairs))


def zone_key(kind: Column, name: Column, region_id: Column) -> Column:
    """kind-name-suffix with other than letters, digits and ``-_.`` replaced, 100 characters at most."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_.-]", "-")
    suffix = F.when(F.coalesce(region_id, F.lit("")) == "", F.lit("zone")).otherwise(F.right(region_id, F.lit(6)))
    return F.left(F.concat(kind, F.lit("-"), F.when(plain == "", kind).otherwise(plain), F.lit("-"), suffix), F.lit(100))
