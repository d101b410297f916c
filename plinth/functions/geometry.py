"""Plane geometry as column expressions.  Points are struct<x,y>, rings array<struct<x,y>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
#: How far beyond its ends, as a share of its length, a segment still meets another.
ON = 1e-7
EARTH = 6378137.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def dist(px: Column, py: Column, qx: Column, qy: Column) -> Column:
    return F.hypot(px - qx, py - qy)


def angle_of(vx: Column, vy: Column) -> Column:
    return F.atan2(vy, vx)


def angle_diff(a: Column, b: Column) -> Column:
    """Signed difference in (-pi, pi]."""
    d = F.pmod(a - b, F.lit(math.tau))
    return F.when(d > math.pi, d - math.tau).otherwise(d)


def fold_gap(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(math.pi))
    return F.least(d, math.pi - d)


def is_parallel(ux: Column, uy: Column, vx: Column, vy: Column, tol_deg: float = 2.0) -> Column:
    real = (F.hypot(ux, uy) >= EPS) & (F.hypot(vx, vy) >= EPS)
    return real & (fold_gap(angle_of(ux, uy), angle_of(vx, vy)) <= math.radians(tol_deg))


def project_param(px, py, ax, ay, bx, by) -> Column:
    """Where the foot of p lies on a-b: 0 at a, 1 at b, beyond outside; 0 for a point-like a-b."""
    dx, dy = bx - ax, by - ay
    return F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, F.when(F.hypot(dx, dy) >= EPS, dx * dx + dy * dy)), F.lit(0.0))


def point_seg_distance(px, py, ax, ay, bx, by) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), project_param(px, py, ax, ay, bx, by)))
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def seg_intersection(ax, ay, bx, by, cx, cy, dx, dy, tol: float = ON) -> Column:
    """struct<x,y> where a-b meets c-d, null if parallel, collinear or apart."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    safe = F.when(F.abs(det) >= EPS, det)
    s = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), safe)
    t = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), safe)
    on = s.between(-tol, 1 + tol) & t.between(-tol, 1 + tol)
    return F.when(on, point(ax + s * (bx - ax), ay + s * (by - ay)))


def ring_edges(ring: Column) -> Column:
    """array<struct<a,b>> of a ring's edges, the closing one last."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["a"]["y"] * e["b"]["x"]


def polygon_area(ring: Column) -> Column:
    """Signed, counter-clockwise positive; 0 under three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(F.transform(ring_edges(ring), _cross)) / 2)


def polygon_perimeter(ring: Column) -> Column:
    return _sum(F.transform(ring_edges(ring), lambda e: dist(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def polygon_centroid(ring: Column) -> Column:
    """struct<x,y>; the mean of the points where the area vanishes."""
    edges, n = ring_edges(ring), F.when(F.size(ring) > 0, F.size(ring))
    part = lambda k: _sum(F.transform(edges, lambda e: (e["a"][k] + e["b"][k]) * _cross(e)))
    mean = lambda k: F.try_divide(_sum(F.transform(ring, lambda p: p[k])), n)
    area = polygon_area(ring)
    safe = F.when(F.abs(area) >= EPS, 6 * area)
    return F.struct(*[F.coalesce(F.try_divide(part(k), safe), mean(k)).alias(k) for k in ("x", "y")])


def point_in_polygon(px: Column, py: Column, ring: Column) -> Column:
    def hit(e: Column) -> Column:
        (ax, ay), (bx, by) = ((e[k]["x"], e[k]["y"]) for k in ("a", "b"))
        return ((ay > py) != (by > py)) & (px < ax + F.try_divide((py - ay) * (bx - ax), by - ay))

    return F.size(F.filter(ring_edges(ring), lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1


def bbox(ring: Column) -> Column:
    lo, hi = (lambda k: F.array_min(F.transform(ring, lambda p: p[k]))), (lambda k: F.array_max(F.transform(ring, lambda p: p[k])))
    return F.struct(lo("x").alias("x0"), lo("y").alias("y0"), hi("x").alias("x1"), hi("y").alias("y1"))


def oriented_extent(ring: Column) -> Column:
    """struct<long,short> in the frame of the longest edge."""
    sized = F.transform(ring_edges(ring), lambda e, i: F.struct(dist(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]).alias("n"), (-i).alias("i"), (e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy")))
    longest = F.array_max(sized)
    n = F.when(longest["n"] > EPS, longest["n"])
    ux, uy = F.try_divide(longest["dx"], n), F.try_divide(longest["dy"], n)
    width = lambda f: F.array_max(F.transform(ring, f)) - F.array_min(F.transform(ring, f))
    along, across = width(lambda p: p["x"] * ux + p["y"] * uy), width(lambda p: p["y"] * ux - p["x"] * uy)
    return F.struct(F.coalesce(F.greatest(along, across), F.lit(0.0)).alias("long"), F.coalesce(F.least(along, across), F.lit(0.0)).alias("short"))


def compactness(ring: Column) -> Column:
    p = polygon_perimeter(ring)
    return F.coalesce(F.try_divide(4 * math.pi * F.abs(polygon_area(ring)), F.when(p > EPS, p * p)), F.lit(0.0))


def local_frame(px, py, ox, oy, dx, dy) -> Column:
    """A point in the frame with origin o and unit direction d."""
    return point((px - ox) * dx + (py - oy) * dy, (py - oy) * dx - (px - ox) * dy)


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, n: int = 16) -> Column:
    step = (end - start) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(cx + r * F.cos(start + step * i), cy + r * F.sin(start + step * i)))


def to_lon_lat(x_mm: Column, y_mm: Column, lat0: float, lon0: float, rotation_deg: float = 0.0) -> Column:
    """Equirectangular about an origin, 9 places."""
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    x, y = (x_mm * c - y_mm * s) / 1000, (x_mm * s + y_mm * c) / 1000
    lon = F.lit(lon0) + F.degrees(x / (EARTH * math.cos(math.radians(lat0))))
    return F.struct(F.round(lon, 9).alias("lon"), F.round(F.lit(lat0) + F.degrees(y / EARTH), 9).alias("lat"))


def circle_sums(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates from which :func:`circle_from` fits a circle."""
    z = x * x + y * y
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sz": z, "sxz": x * z, "syz": y * z}
    return {k: F.sum(v).alias(k) for k, v in terms.items()}


def circle_from() -> Column:
    """struct<cx,cy,r> of the least-squares circle from the columns of :func:`circle_sums`, null
    where the points lie on a line."""
    n, sx, sy, sxx, syy, sxy, sz, sxz, syz = (F.col(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy", "sz", "sxz", "syz"))
    uu, vv, uv = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    uz, vz = sxz - sx * sz / n, syz - sy * sz / n
    det = uu * vv - uv * uv
    safe = F.when(F.abs(det) >= 1e-12, 2 * det)
    cx, cy = F.try_divide(uz * vv - vz * uv, safe), F.try_divide(vz * uu - uz * uv, safe)
    r = F.sqrt(F.greatest(sz / n - 2 * (cx * sx + cy * sy) / n + cx * cx + cy * cy, F.lit(0.0)))
    return F.when(cx.isNotNull(), F.struct(cx.alias("cx"), cy.alias("cy"), r.alias("r")))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def circle_of(points: Column) -> Column:
    """struct<cx,cy,r,rms> of the least-squares circle through an array of points, rms the root mean
    square of what they are off it; null where they lie on a line."""
    n = F.size(points).cast("double")
    total = lambda ps, f: F.aggregate(ps, F.lit(0.0), lambda s, p: s + f(p))
    about = lambda m: F.transform(points, lambda p: F.struct((p["x"] - m["x"]).alias("u"), (p["y"] - m["y"]).alias("v")))
    square = lambda p: p["u"] * p["u"] + p["v"] * p["v"]
    terms = {"uu": lambda p: p["u"] * p["u"], "vv": lambda p: p["v"] * p["v"], "uv": lambda p: p["u"] * p["v"], "uz": lambda p: p["u"] * square(p), "vz": lambda p: p["v"] * square(p)}

    def circle(m: Column, ps: Column, s: Column, det: Column) -> Column:
        u, v = (s["uz"] * s["vv"] - s["vz"] * s["uv"]) / (2 * det), (s["vz"] * s["uu"] - s["uz"] * s["uv"]) / (2 * det)
        r = lambda c: F.sqrt(c["u"] * c["u"] + c["v"] * c["v"] + (s["uu"] + s["vv"]) / n)
        off = lambda c: F.sqrt(total(ps, lambda p: F.pow(F.hypot(p["u"] - c["u"], p["v"] - c["v"]) - c["r"], 2)) / n)
        whole = lambda c: F.struct((c["u"] + m["x"]).alias("cx"), (c["v"] + m["y"]).alias("cy"), c["r"].alias("r"), off(c).alias("rms"))
        return bound(F.struct(u.alias("u"), v.alias("v")), lambda c: bound(F.struct(c["u"].alias("u"), c["v"].alias("v"), r(c).alias("r")), whole))

    def solved(m: Column, ps: Column) -> Column:
        sums = F.struct(*[total(ps, f).alias(k) for k, f in terms.items()])
        return bound(sums, lambda s: bound(s["uu"] * s["vv"] - s["uv"] * s["uv"], lambda det: F.when(F.abs(det) >= 1e-12, circle(m, ps, s, det))))

    mean = F.struct(*[(total(points, lambda p, k=k: p[k]) / n).alias(k) for k in ("x", "y")])
    return F.when(n >= 3, bound(mean, lambda m: bound(about(m), lambda ps: solved(m, ps))))


def arc_span(points: Column, cx: Column, cy: Column) -> Column:
    """How far points turn about a centre, one after the other, in all."""
    ways = F.transform(points, lambda p: F.atan2(p["y"] - cy, p["x"] - cx))
    return _sum(F.zip_with(F.slice(ways, 1, F.greatest(F.size(ways) - 1, F.lit(0))), F.slice(ways, 2, F.size(ways)), lambda a, b: F.abs(angle_diff(b, a))))
