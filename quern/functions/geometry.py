"""Plane geometry: points (x, y), boxes (xh, yh, xl, yl), circles (x, y, r), segments and arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from quern.semantics import _c, bound

EPS = 1e-6


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(p, q) -> Column:
    return F.hypot(_c(p)["x"] - _c(q)["x"], _c(p)["y"] - _c(q)["y"])


def point_add(p, q) -> Column:
    return F.struct((_c(p)["x"] + _c(q)["x"]).alias("x"), (_c(p)["y"] + _c(q)["y"]).alias("y"))


def point_mul(p, q) -> Column:
    """As complex numbers: turn and scale."""
    p, q = _c(p), _c(q)
    return F.struct((p["x"] * q["x"] - p["y"] * q["y"]).alias("x"), (p["x"] * q["y"] + p["y"] * q["x"]).alias("y"))


def point_div(p, q) -> Column:
    p, q = _c(p), _c(q)
    d = q["x"] * q["x"] + q["y"] * q["y"]
    return F.struct(((p["x"] * q["x"] + p["y"] * q["y"]) / d).alias("x"), ((p["y"] * q["x"] - p["x"] * q["y"]) / d).alias("y"))


def slope(p, q) -> Column:
    dx = _c(p)["x"] - _c(q)["x"]
    return F.when(F.abs(dx) <= EPS, F.lit(float("inf"))).otherwise((_c(p)["y"] - _c(q)["y"]) / dx)


def box(p, q) -> Column:
    p, q = _c(p), _c(q)
    return F.struct(F.greatest(p["x"], q["x"]).alias("xh"), F.greatest(p["y"], q["y"]).alias("yh"), F.least(p["x"], q["x"]).alias("xl"), F.least(p["y"], q["y"]).alias("yl"))


def box_area(b) -> Column:
    return (_c(b)["xh"] - _c(b)["xl"]) * (_c(b)["yh"] - _c(b)["yl"])


def box_center(b) -> Column:
    return F.struct(((_c(b)["xh"] + _c(b)["xl"]) / 2).alias("x"), ((_c(b)["yh"] + _c(b)["yl"]) / 2).alias("y"))


def box_overlaps(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["xl"] <= b["xh"]) & (b["xl"] <= a["xh"]) & (a["yl"] <= b["yh"]) & (b["yl"] <= a["yh"])


def box_contains(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["xh"] >= b["xh"]) & (a["xl"] <= b["xl"]) & (a["yh"] >= b["yh"]) & (a["yl"] <= b["yl"])


def box_contains_point(b, p) -> Column:
    b, p = _c(b), _c(p)
    return p["x"].between(b["xl"], b["xh"]) & p["y"].between(b["yl"], b["yh"])


@bound
def box_intersection(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(box_overlaps(a, b), F.struct(F.least(a["xh"], b["xh"]).alias("xh"), F.least(a["yh"], b["yh"]).alias("yh"), F.greatest(a["xl"], b["xl"]).alias("xl"), F.greatest(a["yl"], b["yl"]).alias("yl")))


def circle(p, r) -> Column:
    return F.struct(_c(p)["x"].alias("x"), _c(p)["y"].alias("y"), _c(r).cast("double").alias("r"))


def circle_area(c) -> Column:
    return F.pi() * _c(c)["r"] * _c(c)["r"]


def circle_overlaps(a, b) -> Column:
    return distance(a, b) <= _c(a)["r"] + _c(b)["r"]


def circle_contains(a, b) -> Column:
    return distance(a, b) + _c(b)["r"] <= _c(a)["r"]


def circle_distance(a, b) -> Column:
    return F.greatest(distance(a, b) - _c(a)["r"] - _c(b)["r"], F.lit(0.0))


def _edges(pts: Column, closed: bool) -> Column:
    n = F.size(pts)
    nxt = F.concat(F.slice(pts, 2, 1 << 30), F.slice(pts, 1, 1)) if closed else F.slice(pts, 2, 1 << 30)
    return F.arrays_zip((pts if closed else F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("a"), nxt.alias("b"))


def path_length(pts, closed: bool = False) -> Column:
    return F.aggregate(_edges(_c(pts), closed), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def polygon_area(pts) -> Column:
    """By the shoelace formula."""
    return F.abs(F.aggregate(_edges(_c(pts), True), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_contains(pts, p) -> Column:
    """Ray casting; a point on the border may fall on either side."""
    p = _c(p)

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.aggregate(_edges(_c(pts), True), F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def bounding_box(pts) -> Column:
    g = lambda f, k: f(F.transform(_c(pts), lambda p: p[k]))
    return F.struct(g(F.array_max, "x").alias("xh"), g(F.array_max, "y").alias("yh"), g(F.array_min, "x").alias("xl"), g(F.array_min, "y").alias("yl"))


@bound
def segments_cross(a, b, c, d) -> Column:
    a, b, c, d = map(_c, (a, b, c, d))
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    return (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)


@bound
def point_segment_distance(p, a, b) -> Column:
    p, a, b = map(_c, (p, a, b))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


# literals and text
def parse_points(text: str) -> list[tuple[float, float]]:
    """The points of a path, polygon, box or segment literal."""
    import re

    n = [float(x) for x in re.findall(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text)]
    if len(n) < 2 or len(n) % 2 or re.search(r"[^\d\s().,\[\]<>eE+-]", text):
        raise ValueError(f"invalid geometry: {text!r}")
    return list(zip(n[::2], n[1::2], strict=True))


def points(text: str) -> Column:
    return F.array(*(point(F.lit(x), F.lit(y)) for x, y in parse_points(text)))


def lseg(a, b) -> Column:
    return F.struct(_c(a).alias("a"), _c(b).alias("b"))


def lseg_length(s) -> Column:
    return distance(_c(s)["a"], _c(s)["b"])


def lseg_center(s) -> Column:
    a, b = _c(s)["a"], _c(s)["b"]
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def lseg_horizontal(s) -> Column:
    return F.abs(_c(s)["a"]["y"] - _c(s)["b"]["y"]) <= EPS


def lseg_vertical(s) -> Column:
    return F.abs(_c(s)["a"]["x"] - _c(s)["b"]["x"]) <= EPS


def lseg_parallel(s, t) -> Column:
    d = lambda x: (_c(x)["b"]["x"] - _c(x)["a"]["x"], _c(x)["b"]["y"] - _c(x)["a"]["y"])
    (a, b), (c, e) = d(s), d(t)
    return F.abs(a * e - b * c) <= EPS


def lseg_perpendicular(s, t) -> Column:
    d = lambda x: (_c(x)["b"]["x"] - _c(x)["a"]["x"], _c(x)["b"]["y"] - _c(x)["a"]["y"])
    (a, b), (c, e) = d(s), d(t)
    return F.abs(a * c + b * e) <= EPS


def lseg_intersects(s, t) -> Column:
    return segments_cross(_c(s)["a"], _c(s)["b"], _c(t)["a"], _c(t)["b"])


@bound
def lseg_intersection(s, t) -> Column:
    """The common point; null where there is none or the segments are parallel."""
    a, b, c, d = _c(s)["a"], _c(s)["b"], _c(t)["a"], _c(t)["b"]
    den = (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])
    p, q = a["x"] * b["y"] - a["y"] * b["x"], c["x"] * d["y"] - c["y"] * d["x"]
    safe = F.nullif(den, F.lit(0.0))
    hit = F.struct(((p * (c["x"] - d["x"]) - (a["x"] - b["x"]) * q) / safe).alias("x"), ((p * (c["y"] - d["y"]) - (a["y"] - b["y"]) * q) / safe).alias("y"))
    return F.when(lseg_intersects(s, t) & (F.abs(den) > EPS), hit)


@bound
def closest_point(p, s) -> Column:
    """p ## segment."""
    p, a, b = _c(p), _c(s)["a"], _c(s)["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"))


@bound
def lseg_distance(s, t) -> Column:
    """0 where they meet, else the least distance of an end from the other segment."""
    a, b, c, d = _c(s)["a"], _c(s)["b"], _c(t)["a"], _c(t)["b"]
    near = F.least(point_segment_distance(a, c, d), point_segment_distance(b, c, d), point_segment_distance(c, a, b), point_segment_distance(d, a, b))
    return F.when(lseg_intersects(s, t), F.lit(0.0)).otherwise(near)


def path_add(pts, p) -> Column:
    return F.transform(_c(pts), lambda q: point_add(q, p))


def path_mul(pts, p) -> Column:
    return F.transform(_c(pts), lambda q: point_mul(q, p))


def path_concat(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def npoints(pts) -> Column:
    return F.size(_c(pts))


def path_intersects(a, b) -> Column:
    """Some side of one meets some side of the other (open paths)."""
    return F.exists(_edges(_c(a), False), lambda e: F.exists(_edges(_c(b), False), lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"])))


@bound
def path_distance(a, b) -> Column:
    """Least distance of two open paths' sides."""
    side = lambda e: lseg(e["a"], e["b"])
    return F.array_min(F.transform(_edges(_c(a), False), lambda e: F.array_min(F.transform(_edges(_c(b), False), lambda f: lseg_distance(side(e), side(f))))))


@bound
def polygon_center(pts) -> Column:
    """Mean of the corners."""
    mean = lambda k: F.aggregate(F.transform(_c(pts), lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size(_c(pts))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


@bound
def polygon_overlaps(a, b) -> Column:
    """Sides meet, or one lies in the other."""
    sides = F.exists(_edges(_c(a), True), lambda e: F.exists(_edges(_c(b), True), lambda f: segments_cross(e["a"], e["b"], f["a"], f["b"])))
    return sides | polygon_contains(a, F.element_at(_c(b), 1)) | polygon_contains(b, F.element_at(_c(a), 1))


@bound
def polygon_contains_polygon(a, b) -> Column:
    """Every corner of b lies in a and no side leaves it."""
    inside = F.forall(_c(b), lambda p: polygon_contains(a, p) | on_border(a, p))
    return inside & ~F.exists(_edges(_c(a), True), lambda e: F.exists(_edges(_c(b), True), lambda f: _strictly_cross(e["a"], e["b"], f["a"], f["b"])))


def on_border(pts, p) -> Column:
    return F.exists(_edges(_c(pts), True), lambda e: point_segment_distance(p, e["a"], e["b"]) <= EPS)


def _strictly_cross(a, b, c, d) -> Column:
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def polygon_left(a, b) -> Column:
    """a << b, by the bounding boxes."""
    return bounding_box(a)["xh"] < bounding_box(b)["xl"]


@bound
def polygon_same(a, b) -> Column:
    """The same corners in either direction from any corner."""
    a, b = _c(a), _c(b)
    n = F.size(a)
    turned = lambda x, i: F.concat(F.slice(x, i + 1, 1 << 30), F.slice(x, F.lit(1), i))
    turns = F.sequence(F.lit(0), n - 1)
    return (n == F.size(b)) & F.exists(turns, lambda i: (turned(b, i) == a) | (turned(F.reverse(b), i) == a))


def circle_contains_point(c, p) -> Column:
    return F.hypot(_c(c)["x"] - _c(p)["x"], _c(c)["y"] - _c(p)["y"]) <= _c(c)["r"]


def circle_diameter(c) -> Column:
    return _c(c)["r"] * 2


def circle_point_distance(c, p) -> Column:
    return F.greatest(F.hypot(_c(c)["x"] - _c(p)["x"], _c(c)["y"] - _c(p)["y"]) - _c(c)["r"], F.lit(0.0))


# conversions
def box_to_circle(b) -> Column:
    m = box_center(b)
    return F.struct(m["x"].alias("x"), m["y"].alias("y"), F.hypot(_c(b)["xh"] - m["x"], _c(b)["yh"] - m["y"]).alias("r"))


def circle_to_box(c) -> Column:
    c = _c(c)
    d = c["r"] / F.sqrt(F.lit(2.0))
    return F.struct((c["x"] + d).alias("xh"), (c["y"] + d).alias("yh"), (c["x"] - d).alias("xl"), (c["y"] - d).alias("yl"))


def box_to_polygon(b) -> Column:
    b = _c(b)
    return F.array(point(b["xl"], b["yl"]), point(b["xl"], b["yh"]), point(b["xh"], b["yh"]), point(b["xh"], b["yl"]))


def box_to_diagonal(b) -> Column:
    return lseg(point(_c(b)["xh"], _c(b)["yh"]), point(_c(b)["xl"], _c(b)["yl"]))


def circle_to_polygon(n: int, c) -> Column:
    c = _c(c)
    step = lambda i: F.lit(2 * math.pi / n) * i
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(c["x"] - c["r"] * F.cos(step(i)), c["y"] + c["r"] * F.sin(step(i))))


@bound
def polygon_to_circle(pts) -> Column:
    """Around the mean of the corners, with their mean distance as radius."""
    m = polygon_center(pts)
    r = F.aggregate(F.transform(_c(pts), lambda p: F.hypot(p["x"] - m["x"], p["y"] - m["y"])), F.lit(0.0), lambda s, v: s + v) / F.size(_c(pts))
    return F.struct(m["x"].alias("x"), m["y"].alias("y"), r.alias("r"))
