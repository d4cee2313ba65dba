"""Points, segments, lines, boxes, paths, polygons and circles beyond kinds.py.

point struct(x, y); segment struct(a, b) of points; line struct(a, b, c) for ax + by + c = 0; box struct(x1, y1, x2, y2), the
larger corner first; path struct(points, closed); polygon an array of points; circle struct(x, y, r).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import LARGEST, _f, box, box_center, distance, in_polygon, point, polygon_area, slope
from .scalar import _c

#: Fixed value: numbers that differ by no more are equal.
EPSILON = 1e-6


def _eq(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


# Points


def left(a, b) -> Column:
    return _f(a, "x") < _f(b, "x")


def above(a, b) -> Column:
    """a >^ b."""
    return _f(a, "y") > _f(b, "y")


def vertical(a, b) -> Column:
    """a ?| b."""
    return _eq(_f(a, "x"), _f(b, "x"))


def horizontal(a, b) -> Column:
    """a ?- b."""
    return _eq(_f(a, "y"), _f(b, "y"))


def same(a, b) -> Column:
    """a ~= b."""
    return vertical(a, b) & horizontal(a, b)


def add(a, b) -> Column:
    return _xy(_f(a, "x") + _f(b, "x"), _f(a, "y") + _f(b, "y"))


def subtract(a, b) -> Column:
    return _xy(_f(a, "x") - _f(b, "x"), _f(a, "y") - _f(b, "y"))


def multiply(a, b) -> Column:
    """As complex numbers: scaled and turned."""
    return _xy(_f(a, "x") * _f(b, "x") - _f(a, "y") * _f(b, "y"), _f(a, "x") * _f(b, "y") + _f(a, "y") * _f(b, "x"))


def divide(a, b) -> Column:
    n = _f(b, "x") * _f(b, "x") + _f(b, "y") * _f(b, "y")
    return _xy((_f(a, "x") * _f(b, "x") + _f(a, "y") * _f(b, "y")) / n, (_f(a, "y") * _f(b, "x") - _f(a, "x") * _f(b, "y")) / n)


# Segments


def segment(a, b) -> Column:
    return F.struct(_c(a).alias("a"), _c(b).alias("b"))


def segment_length(s) -> Column:
    return distance(_f(s, "a"), _f(s, "b"))


def segment_center(s) -> Column:
    return point((_f(s, "a").x + _f(s, "b").x) / 2, (_f(s, "a").y + _f(s, "b").y) / 2)


def parallel(s, t) -> Column:
    return _eq(slope(_f(s, "a"), _f(s, "b")), slope(_f(t, "a"), _f(t, "b")))


def perpendicular(s, t) -> Column:
    m, n = slope(_f(s, "a"), _f(s, "b")), slope(_f(t, "a"), _f(t, "b"))
    return F.when(m == LARGEST, _eq(n, F.lit(0.0))).when(n == LARGEST, _eq(m, F.lit(0.0))).otherwise(_eq(m * n, F.lit(-1.0)))


def _cross(o, a, b) -> Column:
    return (_f(a, "x") - _f(o, "x")) * (_f(b, "y") - _f(o, "y")) - (_f(a, "y") - _f(o, "y")) * (_f(b, "x") - _f(o, "x"))


def on_segment(p, s) -> Column:
    """p <@ s."""
    return _eq(distance(p, _f(s, "a")) + distance(p, _f(s, "b")), segment_length(s))


def intersect(s, t) -> Column:
    """s ?# t."""
    a, b, c, d = _f(s, "a"), _f(s, "b"), _f(t, "a"), _f(t, "b")
    apart = (F.signum(_cross(a, b, c)) * F.signum(_cross(a, b, d)) < 0) & (F.signum(_cross(c, d, a)) * F.signum(_cross(c, d, b)) < 0)
    return apart | on_segment(a, t) | on_segment(b, t) | on_segment(c, s) | on_segment(d, s)


def closest_on_segment(p, s) -> Column:
    """p ## s."""
    a, b = _f(s, "a"), _f(s, "b")
    n = (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)
    t = F.when(n == 0, F.lit(0.0)).otherwise(((_f(p, "x") - a.x) * (b.x - a.x) + (_f(p, "y") - a.y) * (b.y - a.y)) / F.nullif(n, F.lit(0.0)))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return _xy(a.x + t * (b.x - a.x), a.y + t * (b.y - a.y))


def point_segment_distance(p, s) -> Column:
    return distance(p, closest_on_segment(p, s))


def segment_distance(s, t) -> Column:
    ends = F.least(*(point_segment_distance(_f(x, e), y) for x, y in ((s, t), (t, s)) for e in ("a", "b")))
    return F.when(intersect(s, t), F.lit(0.0)).otherwise(ends)


# Lines


def line(p, q) -> Column:
    """Through two points; vertical ones as x = c."""
    up = _eq(_f(p, "x"), _f(q, "x"))
    m = slope(p, q)
    return F.struct(F.when(up, F.lit(-1.0)).otherwise(m).alias("a"), F.when(up, F.lit(0.0)).otherwise(F.lit(-1.0)).alias("b"), F.when(up, _f(p, "x")).otherwise(_f(p, "y") - m * _f(p, "x")).alias("c"))


def lines_parallel(k, l) -> Column:
    return F.abs(_f(k, "a") * _f(l, "b") - _f(l, "a") * _f(k, "b")) <= EPSILON


def lines_perpendicular(k, l) -> Column:
    return F.abs(_f(k, "a") * _f(l, "a") + _f(k, "b") * _f(l, "b")) <= EPSILON


def lines_meet(k, l) -> Column:
    """The point; null for parallels."""
    d = _f(k, "a") * _f(l, "b") - _f(l, "a") * _f(k, "b")
    return F.when(~lines_parallel(k, l), _xy((_f(k, "b") * _f(l, "c") - _f(l, "b") * _f(k, "c")) / d, (_f(l, "a") * _f(k, "c") - _f(k, "a") * _f(l, "c")) / d))


def point_line_distance(p, l) -> Column:
    return F.abs(_f(l, "a") * _f(p, "x") + _f(l, "b") * _f(p, "y") + _f(l, "c")) / F.hypot(_f(l, "a"), _f(l, "b"))


def lines_distance(k, l) -> Column:
    """0 where they meet."""
    on = F.when(F.abs(_f(k, "b")) > EPSILON, _xy(F.lit(0.0), -_f(k, "c") / F.nullif(_f(k, "b"), F.lit(0.0)))).otherwise(_xy(-_f(k, "c") / F.nullif(_f(k, "a"), F.lit(0.0)), F.lit(0.0)))
    return F.when(lines_parallel(k, l), point_line_distance(on, l)).otherwise(0.0)


def on_line(p, l) -> Column:
    return point_line_distance(p, l) <= EPSILON


def segment_on_line(s, l) -> Column:
    return on_line(_f(s, "a"), l) & on_line(_f(s, "b"), l)


def segment_line_distance(s, l) -> Column:
    side = lambda p: _f(l, "a") * p.x + _f(l, "b") * p.y + _f(l, "c")
    a, b = _f(s, "a"), _f(s, "b")
    return F.when(side(a) * side(b) <= 0, F.lit(0.0)).otherwise(F.least(point_line_distance(a, l), point_line_distance(b, l)))


# Boxes


def box_width(b) -> Column:
    return _f(b, "x1") - _f(b, "x2")


def box_height(b) -> Column:
    return _f(b, "y1") - _f(b, "y2")


def box_left(a, b) -> Column:
    return _f(a, "x1") < _f(b, "x2")


def box_right(a, b) -> Column:
    return _f(a, "x2") > _f(b, "x1")


def box_above(a, b) -> Column:
    """a |>> b."""
    return _f(a, "y2") > _f(b, "y1")


def box_below(a, b) -> Column:
    return _f(a, "y1") < _f(b, "y2")


def box_diagonal(b) -> Column:
    return segment(point(_f(b, "x1"), _f(b, "y1")), point(_f(b, "x2"), _f(b, "y2")))


def box_moved(b, p) -> Column:
    """b + p."""
    return box(point(_f(b, "x1") + _f(p, "x"), _f(b, "y1") + _f(p, "y")), point(_f(b, "x2") + _f(p, "x"), _f(b, "y2") + _f(p, "y")))


def box_inter(a, b) -> Column:
    """a # b; null where they don't meet."""
    x1, y1, x2, y2 = F.least(_f(a, "x1"), _f(b, "x1")), F.least(_f(a, "y1"), _f(b, "y1")), F.greatest(_f(a, "x2"), _f(b, "x2")), F.greatest(_f(a, "y2"), _f(b, "y2"))
    return F.when((x1 >= x2) & (y1 >= y2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def in_box(p, b) -> Column:
    """p <@ b."""
    return _f(p, "x").between(_f(b, "x2"), _f(b, "x1")) & _f(p, "y").between(_f(b, "y2"), _f(b, "y1"))


def segment_in_box(s, b) -> Column:
    return in_box(_f(s, "a"), b) & in_box(_f(s, "b"), b)


def point_box_distance(p, b) -> Column:
    dx = F.greatest(_f(b, "x2") - _f(p, "x"), _f(p, "x") - _f(b, "x1"), F.lit(0.0))
    dy = F.greatest(_f(b, "y2") - _f(p, "y"), _f(p, "y") - _f(b, "y1"), F.lit(0.0))
    return F.hypot(dx, dy)


def box_distance(a, b) -> Column:
    """Between centres."""
    return distance(box_center(a), box_center(b))


# Paths and polygons


def path(points, closed: bool = False) -> Column:
    return F.struct(_c(points).alias("points"), F.lit(closed).alias("closed"))


def npoints(p) -> Column:
    return F.size(_f(p, "points"))


def popen(p) -> Column:
    return F.struct(_f(p, "points").alias("points"), F.lit(False).alias("closed"))


def pclose(p) -> Column:
    return F.struct(_f(p, "points").alias("points"), F.lit(True).alias("closed"))


def segments(p) -> Column:
    """A path's segments; of a closed one the last leads to the first point."""
    q = _f(p, "points")
    all_ = F.transform(q, lambda a, i: F.struct(a.alias("a"), F.get(q, F.pmod(i + 1, F.size(q))).alias("b")))
    return F.slice(all_, F.lit(1), F.size(q) - F.when(_f(p, "closed"), 0).otherwise(1))


def path_length(p) -> Column:
    return F.aggregate(F.transform(segments(p), segment_length), F.lit(0.0), lambda s, x: s + x)


def path_area(p) -> Column:
    """Null for an open path."""
    return F.when(_f(p, "closed"), polygon_area(_f(p, "points")))


def path_joined(p, q) -> Column:
    """p + q of open paths; null else."""
    return F.when(~_f(p, "closed") & ~_f(q, "closed"), F.struct(F.concat(_f(p, "points"), _f(q, "points")).alias("points"), F.lit(False).alias("closed")))


def path_moved(p, by) -> Column:
    return F.struct(F.transform(_f(p, "points"), lambda x: add(x, by)).alias("points"), _f(p, "closed").alias("closed"))


def paths_meet(p, q) -> Column:
    """p ?# q."""
    return F.exists(segments(p), lambda s: F.exists(segments(q), lambda t: intersect(s, t)))


def path_distance(p, q) -> Column:
    return F.array_min(F.flatten(F.transform(segments(p), lambda s: F.transform(segments(q), lambda t: segment_distance(s, t)))))


def point_path_distance(x, p) -> Column:
    return F.array_min(F.transform(segments(p), lambda s: point_segment_distance(x, s)))


def on_path(x, p) -> Column:
    """x <@ p: on an open path, in or on a closed one."""
    return F.exists(segments(p), lambda s: on_segment(x, s)) | (_f(p, "closed") & in_polygon(_f(p, "points"), x))


def polygon_box(q) -> Column:
    xs, ys = F.transform(_c(q), lambda p: p.x), F.transform(_c(q), lambda p: p.y)
    return F.struct(F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.array_min(xs).alias("x2"), F.array_min(ys).alias("y2"))


def polygon_center(q) -> Column:
    """The mean of its points."""
    mean = lambda c: F.aggregate(F.transform(_c(q), lambda p: p[c]), F.lit(0.0), lambda s, x: s + x) / F.size(_c(q))
    return point(mean("x"), mean("y"))


def polygon_left(a, b) -> Column:
    return box_left(polygon_box(a), polygon_box(b))


def polygon_right(a, b) -> Column:
    return box_right(polygon_box(a), polygon_box(b))


def polygon_contains(a, b) -> Column:
    """All of b's points lie in or on a."""
    return F.forall(_c(b), lambda p: on_path(p, path(_c(a), True)))


def polygon_overlap(a, b) -> Column:
    return paths_meet(path(_c(a), True), path(_c(b), True)) | polygon_contains(a, b) | polygon_contains(b, a)


def polygon_distance(a, b) -> Column:
    return F.when(polygon_overlap(a, b), F.lit(0.0)).otherwise(path_distance(path(_c(a), True), path(_c(b), True)))


# Circles


def circle(p, r) -> Column:
    return F.struct(_f(p, "x").alias("x"), _f(p, "y").alias("y"), _c(r).cast("double").alias("r"))


def diameter(c) -> Column:
    return 2 * _f(c, "r")


def in_circle(p, c) -> Column:
    return distance(p, c) <= _f(c, "r")


def circle_contains(a, b) -> Column:
    return distance(a, b) <= _f(a, "r") - _f(b, "r")


def circle_moved(c, p) -> Column:
    return F.struct((_f(c, "x") + _f(p, "x")).alias("x"), (_f(c, "y") + _f(p, "y")).alias("y"), _f(c, "r").alias("r"))


def circle_scaled(c, p) -> Column:
    """c * p: turned about the origin and scaled."""
    m = multiply(c, p)
    return F.struct(m.getField("x").alias("x"), m.getField("y").alias("y"), (_f(c, "r") * F.hypot(_f(p, "x"), _f(p, "y"))).alias("r"))


def point_circle_distance(p, c) -> Column:
    return F.greatest(distance(p, c) - _f(c, "r"), F.lit(0.0))


def circle_polygon_distance(c, q) -> Column:
    near = F.greatest(point_path_distance(c, path(_c(q), True)) - _f(c, "r"), F.lit(0.0))
    return F.when(in_polygon(q, c), F.lit(0.0)).otherwise(near)


# Conversions


def box_polygon(b) -> Column:
    x1, y1, x2, y2 = (_f(b, k) for k in ("x1", "y1", "x2", "y2"))
    return F.array(_xy(x2, y2), _xy(x2, y1), _xy(x1, y1), _xy(x1, y2))


def box_circle(b) -> Column:
    """The circle through the corners."""
    return circle(box_center(b), segment_length(box_diagonal(b)) / 2)


def circle_box(c) -> Column:
    """The square within."""
    d = _f(c, "r") / math.sqrt(2)
    return box(point(_f(c, "x") + d, _f(c, "y") + d), point(_f(c, "x") - d, _f(c, "y") - d))


def circle_polygon(c, n: int = 12) -> Column:
    """n points on it, from the left one on."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _xy(_f(c, "x") - _f(c, "r") * F.cos(i * (2 * math.pi / n)), _f(c, "y") + _f(c, "r") * F.sin(i * (2 * math.pi / n))))


def polygon_circle(q) -> Column:
    """About the centre, with the mean distance of the points."""
    m = polygon_center(q)
    return circle(m, F.aggregate(F.transform(_c(q), lambda p: distance(p, m)), F.lit(0.0), lambda s, x: s + x) / F.size(_c(q)))


def polygon_path(q) -> Column:
    return path(q, True)


def path_polygon(p) -> Column:
    """Of a closed path."""
    return F.when(_f(p, "closed"), _f(p, "points"))
