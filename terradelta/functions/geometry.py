"""Polygon functions as Column expressions.

A geometry is array<array<array<struct<x,y>>>>: polygons, their rings (the first is the shell), points. Everything here stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def let(value: Column, then) -> Column:
    """then(value), where value is worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle as a geometry."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))))


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.concat_ws(" ", x, y)
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)), F.lit("))"))


def parse_wkt(wkt: Column) -> Column:
    """POLYGON and MULTIPOLYGON text as a geometry; anything else, or numbers that can't be read, is null."""
    head = r"^MULTIPOLYGON(?: ?Z)?\(|^POLYGON(?: ?Z)? ?"

    def point(text: Column) -> Column:
        return let(F.split(text, " "), lambda xy: F.struct(xy[0].try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")))

    def parts(text: Column) -> Column:
        body = F.regexp_replace(text, head, "")
        inner = F.when(text.startswith("MULTIPOLYGON"), F.regexp_replace(body, r"\)$", "")).otherwise(body)
        polygons = F.split(F.regexp_replace(inner, r"^\(\(|\)\)$", ""), r"\)\),\(\(")
        return F.transform(polygons, lambda p: F.transform(F.split(p, r"\),\("), lambda r: F.transform(F.split(r, ","), point)))

    plain = F.regexp_replace(F.regexp_replace(F.upper(F.trim(wkt)), r"\s*([(),])\s*", "$1"), r"\s+", " ")
    whole = lambda out: F.when(~F.exists(out, lambda p: F.exists(p, lambda r: F.exists(r, lambda q: q["x"].isNull() | q["y"].isNull()))), out)
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON(\s*Z)?\s*\(\("), let(let(plain, parts), whole))


def to_wkt(geometry: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))
    polygons = F.transform(geometry, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")")))
    return F.when(F.size(geometry) == 1, F.concat(F.lit("POLYGON "), polygons[0])).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(polygons, ", "), F.lit(")")))


def _edges(ring: Column) -> Column:
    """Structs (a, b) of a closed ring's neighbouring points."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _ring_sum(geometry: Column, of, outer) -> Column:
    """Sum over rings of outer(sum over edges of of(edge), whether the ring is a shell)."""
    rings = lambda p: F.transform(p, lambda r, i: outer(_total(F.transform(_edges(r), of)), i == 0))
    return _total(F.flatten(F.transform(geometry, rings)))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def origin(geometry: Column) -> Column:
    """The first point; sums are taken from there, since products of map coordinates would cancel."""
    return geometry[0][0][0]


def moved(geometry: Column, by: Column) -> Column:
    """The geometry less a point."""
    point = lambda p: F.struct((p["x"] - by["x"]).alias("x"), (p["y"] - by["y"]).alias("y"))
    return F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def _near(geometry: Column) -> Column:
    """The geometry less its first point, which is worked out once for all points."""
    return let(origin(geometry), lambda by: moved(geometry, by))


def area(geometry: Column) -> Column:
    """Shells less holes, whatever the rings' direction."""
    return let(geometry, lambda g: let(_near(g), _size))


def _size(near: Column) -> Column:
    return _ring_sum(near, _cross, lambda s, shell: F.when(shell, F.abs(s)).otherwise(-F.abs(s)) / 2)


def perimeter(geometry: Column) -> Column:
    return _ring_sum(geometry, lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]), lambda s, _: s)


def bounds(geometry: Column) -> Column:
    points = F.flatten(F.flatten(geometry))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def centroid(geometry: Column) -> Column:
    """Area-weighted centroid, holes taken out; null without area."""

    def moment(near: Column, axis: str) -> Column:
        def outer(ring: Column, shell: Column) -> Column:
            m = lambda e: (_total(F.transform(e, _cross)), _total(F.transform(e, lambda x: (x["a"][axis] + x["b"][axis]) * _cross(x))) / 6)
            signed = lambda turn, v: F.when(shell, v * F.signum(turn)).otherwise(-v * F.signum(turn))
            return let(_edges(ring), lambda e: signed(*m(e)))

        return _total(F.flatten(F.transform(near, lambda p: F.transform(p, lambda r, i: outer(r, i == 0)))))

    first = origin(geometry)
    middle = lambda near: let(_size(near), lambda size: F.struct((F.try_divide(moment(near, "x"), size) + first["x"]).alias("x"), (F.try_divide(moment(near, "y"), size) + first["y"]).alias("y")))
    return let(moved(geometry, first), middle)


def edges(geometry: Column) -> Column:
    """Edges that aren't upright, from left to right: x0, y0, x1, y1, and sign: whether the shape lies below the edge (1) or above it (-1).

    Worked out once for each object, before pairs are made.
    """

    def of_ring(ring: Column, shell: Column) -> Column:
        all_ = _edges(ring)
        first = ring[0]
        cross = lambda e: (e["a"]["x"] - first["x"]) * (e["b"]["y"] - first["y"]) - (e["b"]["x"] - first["x"]) * (e["a"]["y"] - first["y"])
        turn = F.signum(_total(F.transform(all_, cross)))  # 1 counter-clockwise

        def edge(e: Column) -> Column:
            left = e["a"]["x"] < e["b"]["x"]
            p = lambda k, axis: F.when(left, e["a" if k == 0 else "b"][axis]).otherwise(e["b" if k == 0 else "a"][axis])
            sign = F.when(left, -turn).otherwise(turn) * F.when(shell, 1.0).otherwise(-1.0)
            return F.struct(p(0, "x").alias("x0"), p(0, "y").alias("y0"), p(1, "x").alias("x1"), p(1, "y").alias("y1"), sign.alias("sign"))

        return F.transform(F.filter(all_, lambda e: e["a"]["x"] != e["b"]["x"]), edge)

    return F.flatten(F.flatten(F.transform(geometry, lambda p: F.transform(p, lambda r, i: of_ring(r, i == 0)))))


def common_area(a: Column, b: Column) -> Column:
    """Area common to two shapes given as edges(): holes, parts and concave rings count as they are.

    A shape is the signed sum of the strips below its edges, so the common area is the sum over pairs of edges of the
    area below both: the integral of the lower one where they stand above each other.
    """
    first = a[0]
    at = lambda g, x: g["y0"] - first["y0"] + (x - g["x0"]) * (g["y1"] - g["y0"]) / (g["x1"] - g["x0"])

    def lower(h: Column) -> Column:
        """The mean of the lower edge: that of both ends' lower ones, and what a crossing between them adds."""
        p, q = h["eu"] - h["fu"], h["ev"] - h["fv"]
        return (F.least(h["eu"], h["fu"]) + F.least(h["ev"], h["fv"])) / 2 + F.when(p * q < 0, F.abs(p * q) / (F.abs(p) + F.abs(q)) / 2).otherwise(0.0)

    def below(e: Column, f: Column) -> Column:
        heights = lambda r: F.struct(at(e, r["u"]).alias("eu"), at(e, r["v"]).alias("ev"), at(f, r["u"]).alias("fu"), at(f, r["v"]).alias("fv"))
        strip = lambda r: F.when(r["u"] < r["v"], e["sign"] * f["sign"] * (r["v"] - r["u"]) * let(heights(r), lower)).otherwise(0.0)
        return let(F.struct(F.greatest(e["x0"], f["x0"]).alias("u"), F.least(e["x1"], f["x1"]).alias("v")), strip)

    total = F.aggregate(a, F.lit(0.0), lambda s, e: s + F.aggregate(b, F.lit(0.0), lambda t, f: t + below(e, f)))
    return F.coalesce(F.greatest(total, F.lit(0.0)), F.lit(0.0))


def _hull_chain(ordered: Column) -> Column:
    """The points in order, each dropping those that it makes concave."""
    turn = lambda o, p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])

    def add(stack: Column, q: Column) -> Column:
        return F.concat(F.filter(stack, lambda p, i: (i == 0) | (turn(F.get(stack, i - 1), p, q) > 0)), F.array(q))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def _hull_chains(points: Column) -> Column:
    """Once from below and once from above; each chain ends where the other begins."""
    return F.array(_hull_chain(points), _hull_chain(F.reverse(points)))


def hull_area(geometry: Column) -> Column:
    """Area of the convex hull."""
    near = moved(geometry, origin(geometry))
    around = lambda points: F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_total(F.transform(_hull_chains(points), lambda r: _total(F.transform(_edges(r), _cross))))) / 2)
    return let(F.sort_array(F.array_distinct(F.flatten(F.flatten(near)))), around)


def hull(geometry: Column) -> Column:
    """The convex hull as a geometry; empty if it has no area."""
    ring = lambda chains: F.concat(chains[0], F.slice(chains[1], 2, F.size(chains[1])))
    around = lambda points: let(_hull_chains(points), lambda c: F.when(F.size(c[0]) + F.size(c[1]) < 5, F.slice(F.array(F.array(ring(c))), 1, 0)).otherwise(F.array(F.array(ring(c)))))
    return F.when(F.size(geometry) > 0, let(F.sort_array(F.array_distinct(F.flatten(F.flatten(geometry)))), around)).otherwise(geometry)


def _polygon_sides(geometry: Column) -> Column:
    return F.flatten(F.flatten(F.transform(geometry, lambda p: F.transform(p, _edges))))


def _side_distance2(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.least(F.greatest(F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    gap = lambda v, k, d: v - e["a"][k] - t * d
    return gap(x, "x", dx) * gap(x, "x", dx) + gap(y, "y", dy) * gap(y, "y", dy)


def boundary_distance2(geometry: Column, x: Column, y: Column) -> Column:
    """Squared distance of a point to the nearest ring; infinite without rings."""
    return F.aggregate(_polygon_sides(geometry), F.lit(float("inf")), lambda s, e: F.least(s, _side_distance2(e, x, y)))


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by crossings to its right. On an edge that may be either: see touches()."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]))

    return F.size(F.filter(_polygon_sides(geometry), crossed)) % 2 == 1


def touches(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a point is on a ring."""
    return boundary_distance2(geometry, x, y) == 0


def covers(geometry: Column, x: Column, y: Column) -> Column:
    return contains(geometry, x, y) | touches(geometry, x, y)


def interior_point(geometry: Column) -> Column:
    """A point inside: the middle of the widest span on a line half way between the corners next above and below the middle height.

    Each polygon has its line; the first of the widest spans counts. Null for an empty geometry.
    """

    def spans(polygon: Column) -> Column:
        heights = F.transform(F.flatten(polygon), lambda p: p["y"])
        sides = F.flatten(F.transform(polygon, _edges))

        def across(z: Column) -> Column:
            lows, highs = F.filter(z["ys"], lambda v: v <= z["mid"]), F.filter(z["ys"], lambda v: v > z["mid"])
            line = (F.array_max(lows) + F.coalesce(F.array_min(highs), F.array_max(z["ys"]))) / 2
            return F.struct(z["sides"].alias("sides"), line.alias("y"))

        def cut(z: Column) -> Column:
            hit = F.filter(z["sides"], lambda e: (e["a"]["y"] > z["y"]) != (e["b"]["y"] > z["y"]))
            at = lambda e: e["a"]["x"] + (z["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
            return F.struct(F.sort_array(F.transform(hit, at)).alias("xs"), z["y"].alias("y"))

        def pairs(z: Column) -> Column:
            first = F.filter(z["xs"], lambda x, i: i % 2 == 0)
            second = F.filter(z["xs"], lambda x, i: i % 2 == 1)
            return F.zip_with(first, second, lambda a, b: F.struct((b - a).alias("width"), ((a + b) / 2).alias("x"), z["y"].alias("y")))

        start = F.struct(heights.alias("ys"), ((F.array_min(heights) + F.array_max(heights)) / 2).alias("mid"), sides.alias("sides"))
        return let(let(let(start, across), cut), pairs)

    every = F.flatten(F.transform(geometry, spans))
    none = F.struct(F.lit(-1.0).alias("width"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    best = F.aggregate(every, none, lambda s, v: F.when(v["width"] > s["width"], v).otherwise(s))
    return F.when(F.size(geometry) > 0, let(best, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))


def meets_box(geometry: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a geometry and a rectangle have a point in common, edges included: a side that meets it, or the rectangle within."""

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0)
        side = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(_polygon_sides(geometry), meets) | contains(geometry, x0.cast("double"), y0.cast("double"))


def concavity(size: Column, hull: Column) -> Column:
    """Area against the hull's, 1 for an empty geometry."""
    return F.coalesce(F.try_divide(size, F.when(hull > 0, hull)), F.lit(1.0))


def polygon_parts(geometry: Column) -> Column:
    """Each polygon as a geometry of its own, to explode."""
    return F.transform(geometry, lambda p: F.array(p))


def distance(a: Column, b: Column, common: Column) -> Column:
    """Least distance of two geometries, 0 where they have area in common: that of a corner to an edge."""

    def to_edge(p: Column, e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.least(F.greatest(F.coalesce(F.try_divide((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.hypot(p["x"] - e["a"]["x"] - t * dx, p["y"] - e["a"]["y"] - t * dy)

    def least(g: Column, h: Column) -> Column:
        points, sides = F.flatten(F.flatten(g)), F.flatten(F.flatten(F.transform(h, lambda p: F.transform(p, _edges))))
        return F.aggregate(points, F.lit(float("inf")), lambda s, p: F.least(s, F.aggregate(sides, F.lit(float("inf")), lambda t, e: F.least(t, to_edge(p, e)))))

    return F.when(common > 0, 0.0).otherwise(F.least(least(a, b), least(b, a)))


def centroid_shift(a: Column, b: Column) -> Column:
    """Distance of two centroids; infinite where one is missing."""
    return F.coalesce(F.hypot(a["x"] - b["x"], a["y"] - b["y"]), F.lit(float("inf")))


def compactness(a: Column, length: Column) -> Column:
    """4 pi A / P^2, 0 for an empty geometry."""
    return F.coalesce(F.try_divide(4 * math.pi * a, length * length), F.lit(0.0))


def holes(geometry: Column) -> Column:
    return F.aggregate(geometry, F.lit(0), lambda s, p: s + F.size(p) - 1)


def area_diff_frac(new: Column, old: Column, zero: float | None = None) -> Column:
    """(new - old) / old; an old area of 0 gives `zero`."""
    out = F.try_divide(new - old, old)
    return out if zero is None else F.when(old == 0, F.lit(zero)).otherwise(out)


def box_overlap(a: str, b: str) -> Column:
    """Area common to the boxes in columns <a>x0 ... and <b>x0 ..., 0 if they don't meet."""
    c = F.col
    w = F.least(c(f"{a}x1"), c(f"{b}x1")) - F.greatest(c(f"{a}x0"), c(f"{b}x0"))
    h = F.least(c(f"{a}y1"), c(f"{b}y1")) - F.greatest(c(f"{a}y0"), c(f"{b}y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def box_iou(a: str, b: str) -> Column:
    c = F.col
    size = lambda p: (c(f"{p}x1") - c(f"{p}x0")) * (c(f"{p}y1") - c(f"{p}y0"))
    common = box_overlap(a, b)
    return F.coalesce(F.try_divide(common.cast("double"), (size(a) + size(b) - common).cast("double")), F.lit(0.0))


def box_distance2(a: str, b: str) -> Column:
    """Squared distance of two boxes' boundaries, 0 if they meet."""
    c = F.col
    gap = lambda k: F.greatest(F.lit(0), c(f"{b}{k}0") - c(f"{a}{k}1"), c(f"{a}{k}0") - c(f"{b}{k}1"))
    return gap("x") * gap("x") + gap("y") * gap("y")


def centre_distance2(a: str, b: str) -> Column:
    """Four times the squared distance of two boxes' centres: whole numbers stay whole."""
    c = F.col
    d = lambda k: c(f"{a}{k}0") + c(f"{a}{k}1") - c(f"{b}{k}0") - c(f"{b}{k}1")
    return d("x") * d("x") + d("y") * d("y")


def chip_window(x0: Column, y0: Column, x1: Column, y1: Column, context: float = 1.35, padding: float = 6.0, least: float = 35.0, most: float = 110.0, centre: Column | None = None) -> Column:
    """The square around a box: its longer side times context and padding, clamped, about its centre or another point."""
    side = F.least(F.greatest(F.greatest(x1 - x0, y1 - y0) * context + 2 * padding, F.lit(least)), F.lit(most))
    cx, cy = ((x0 + x1) / 2, (y0 + y1) / 2) if centre is None else (centre["x"], centre["y"])
    return F.struct((cx - side / 2).alias("left"), (cy - side / 2).alias("bottom"), (cx + side / 2).alias("right"), (cy + side / 2).alias("top"))


def pixel_crop(window: Column, left: Column, bottom: Column, right: Column, top: Column, width: int, height: int) -> Column:
    """Whole pixels (x0, y0) to (x1, y1), the last ones not included, of a window in an image with these bounds, cut to it; null where nothing is left.

    Places within a millionth of a pixel of a whole one are that one.
    """
    near = world_to_pixel(window["left"], window["top"], left, bottom, right, top, width, height)
    far = world_to_pixel(window["right"], window["bottom"], left, bottom, right, top, width, height)
    low = lambda v: F.greatest(F.floor(F.round(v, 6)), F.lit(0)).cast("long")
    high = lambda v, most: F.least(F.ceil(F.round(v, 6)), F.lit(most)).cast("long")
    crop = F.struct(low(near["x"]).alias("x0"), low(near["y"]).alias("y0"), high(far["x"], width).alias("x1"), high(far["y"], height).alias("y1"))
    return let(crop, lambda p: F.when((p["x0"] < p["x1"]) & (p["y0"] < p["y1"]), p))


def world_to_pixel(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column, width: int, height: int) -> Column:
    """Column and row of a point; rows count down from the top."""
    return F.struct(((x - left) / (right - left) * width).alias("x"), ((top - y) / (top - bottom) * height).alias("y"))


def utm_from_degrees(lon: Column, lat: Column, meridian: float = 15.0) -> Column:
    """ETRS89 / UTM (zone 33 by default) by Krueger's series to n^4, on GRS80."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * radius * x).alias("x"), (0.9996 * radius * y).alias("y"))


def centre_box(width: Column | int, height: Column | int, share: float) -> Column:
    """The box of that share of an image about its centre, within its first and last pixels."""
    w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    near = lambda v: F.greatest(F.lit(0.0), v / 2 - v * share / 2)
    far = lambda v: F.least(v - 1, v / 2 + v * share / 2)
    return F.struct(near(w).alias("x0"), near(h).alias("y0"), far(w).alias("x1"), far(h).alias("y1"))
