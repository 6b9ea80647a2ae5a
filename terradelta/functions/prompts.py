"""Prompt points for a segmentation model: deep inside a polygon, around it, in its holes, and in the gaps to its hull."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry as g
from . import overlay

#: Points of a grid over the bounds, along each side, edges included.
SIDE = 9
#: Rows whose grid points meet their edges at once.
BLOCK = 512

_POINT = [T.StructField(k, T.DoubleType()) for k in ("x", "y", "depth2")]
_PLACES = T.ArrayType(T.StructType(_POINT[:2]))


def _measured(p: overlay.Points, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points are in their row's geometry (on an edge that may be either), and their squared distance to the nearest edge."""
    to = overlay._following(p.ring)
    begin = np.searchsorted(p.row, np.arange(row.max() + 2))
    count = np.diff(begin)[row]
    at = np.repeat(np.arange(len(row)), count)
    e = np.repeat(begin[row] - (np.cumsum(count) - count), count) + np.arange(len(at))
    ax, ay, bx, by = p.x[e], p.y[e], p.x[to[e]], p.y[to[e]]
    dx, dy, px, py = bx - ax, by - ay, x[at], y[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.clip(np.nan_to_num(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)), 0, 1)
        crossed = ((ay > py) != (by > py)) & (px < ax + (py - ay) * dx / dy)
    far = (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
    first = np.cumsum(count) - count
    depth2 = np.minimum.reduceat(far, first)
    return np.add.reduceat(crossed.astype(np.int64), first) % 2 == 1, depth2


def _bounds(p: overlay.Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have points, and their least and greatest x and y."""
    rows, first = np.unique(p.row, return_index=True)
    return rows, *(np.stack([f.reduceat(v, first) for v in (p.x, p.y)]) for f in (np.minimum, np.maximum))


def _lists(row: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Points in the order of their rows as n lists; null where not known."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
    return lists if known is None else pc.if_else(pa.array(known), lists, pa.scalar(None, lists.type))


def _grid_points(geometry: pa.Array) -> tuple[np.ndarray, ...]:
    """row, x, y and squared depth of a grid over the bounds, line by line, where the geometry covers it."""
    p = overlay.points(geometry)
    if not len(p.row):
        return (np.zeros(0, np.int64), *(np.zeros(0),) * 3)
    rows, low, high = _bounds(p)
    step = np.arange(SIDE) / (SIDE - 1)
    across, down = (low[k][:, None] + step * (high[k] - low[k])[:, None] for k in (0, 1))
    row, x, y = np.repeat(rows, SIDE * SIDE), np.tile(across, (1, SIDE)).ravel(), np.repeat(down, SIDE, axis=1).ravel()
    inside, depth2 = _measured(p, row, x, y)
    inside |= depth2 == 0
    return row[inside], x[inside], y[inside], depth2[inside]


@F.arrow_udf(T.ArrayType(T.StructType(_POINT)))
def _grid(geometry: pa.Array) -> pa.Array:
    out = []
    for a in range(0, len(geometry), BLOCK):
        row, *rest = _grid_points(geometry.slice(a, BLOCK))
        out.append((row + a, *rest))
    row, *values = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4))
    ends = np.searchsorted(row, np.arange(len(geometry) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v) for v in values], names=["x", "y", "depth2"]))


def spread(points: Column, n: Column) -> Column:
    """The first of the points, then always the one farthest from those taken so far, up to n; of equal ones the first. Up to n points stay as they are."""
    d2 = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    start = F.struct(F.slice(points, 1, 1).alias("taken"), F.slice(points, 2, F.size(points)).alias("left"))

    def step(s: Column, _: Column) -> Column:
        far = F.transform(s["left"], lambda p: F.array_min(F.transform(s["taken"], lambda q: d2(p, q))))
        place = g.let(far, lambda v: F.array_position(v, F.array_max(v)))
        took = lambda at: F.struct(F.concat(s["taken"], F.array(F.get(s["left"], (at - 1).cast("int")))).alias("taken"), F.filter(s["left"], lambda p, i: i != at - 1).alias("left"))
        return F.when(F.size(s["left"]) == 0, s).otherwise(g.let(place, took))

    chosen = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, step, lambda s: s["taken"])
    return F.when(n < 1, F.slice(points, 1, 0)).when((F.size(points) <= n) | (n == 1), F.slice(points, 1, F.greatest(n, F.lit(1)))).otherwise(chosen)


def once(points: Column) -> Column:
    """Points (x, y) without those that agree with an earlier one in tenths."""
    key = lambda p: F.struct(F.bround(p["x"], 1), F.bround(p["y"], 1))
    return g.let(F.transform(points, key), lambda keys: F.filter(points, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def grid(geometry: Column) -> Column:
    """Structs (x, y, depth2) of a grid over the bounds where the geometry covers it; a column of its own, for candidates()."""
    return F.when(geometry.isNotNull(), _grid(geometry))


def candidates(geometry: Column, grid_: Column) -> Column:
    """The interior point, the centroid if it is covered, and the grid: the deepest first, equal ones in this order, of those that agree in tenths the first."""
    deep = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), g.boundary_distance2(geometry, p["x"], p["y"]).alias("depth2"))
    centre = g.let(g.centroid(geometry), lambda p: F.when(g.covers(geometry, p["x"], p["y"]), F.array(deep(p))))
    own = F.concat(F.array(g.let(g.interior_point(geometry), deep)), F.coalesce(centre, F.slice(grid_, 1, 0)))
    placed = F.transform(F.concat(own, grid_), lambda p, i: F.struct((-F.round(p["depth2"], 9)).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    ordered = F.transform(F.sort_array(placed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.when(F.size(geometry) > 0, g.let(ordered, once))


def extra(points: Column, base: int, more: int, complex_: Column) -> Column:
    """For complex shapes, what `more` points of these candidates add to the first `base`; none for others."""
    every = spread(points, F.lit(base + more))
    return F.when(complex_, F.slice(every, base + 1, more)).otherwise(F.slice(every, 1, 0))


def around(geometry: Column, n: Column, margin: float, width: int, height: int, share: float = 0.18, clear: float = 2.0) -> Column:
    """Up to n of 16 places on a frame around the bounds, at least `margin` or a share of the longer side away, within the image and clear of the shape."""

    def free(geometry: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = overlay.points(geometry)
        if not len(p.row):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        rows, low, high = _bounds(p)
        away = np.maximum(float(margin), share * np.maximum(*(high - low)))
        at = []
        for a, b, most in zip(low, high, (width, height), strict=True):
            first, last = np.maximum(0.0, a - away), np.minimum(float(most - 1), b + away)
            at.append((first, (first + a) / 2, (a + b) / 2, (b + last) / 2, last))
        # fixed values: order of the places, corners and middles first, clockwise from the first corner
        order = ((0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2), (1, 0), (3, 0), (4, 1), (4, 3), (3, 4), (1, 4), (0, 3), (0, 1))
        row = np.repeat(rows, len(order))
        x, y = (np.stack([at[k][o[k]] for o in order], axis=1).ravel() for k in (0, 1))
        inside, depth2 = _measured(p, row, x, y)
        kept = ~inside & (depth2 >= clear * clear)
        return row[kept], x[kept], y[kept]

    @F.arrow_udf(_PLACES)
    def places(geometry: pa.Array) -> pa.Array:
        out = [(r + a, x, y) for a in range(0, len(geometry), BLOCK) for r, x, y in [free(geometry.slice(a, BLOCK))]]
        row, x, y = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        return _lists(row, len(geometry), x, y, np.asarray(overlay._lengths(geometry) > 0))

    return g.let(g.let(places(geometry), once), lambda p: spread(p, n))


def in_holes(geometry: Column, n: int, least: float) -> Column:
    """A point in each hole of at least that area, at most n, in the order of the holes."""
    holes = F.flatten(F.transform(geometry, lambda p: F.slice(p, 2, F.size(p))))
    large = F.filter(F.transform(holes, lambda r: F.array(F.array(r))), lambda h: g.area(h) >= least)
    return F.slice(g.let(F.transform(large, g.interior_point), once), 1, n)


def of_size(parts: Column, least: float) -> Column:
    """The polygons of at least that area."""
    return F.filter(parts, lambda p: g.area(F.array(p)) >= least)


def in_gaps(gaps: Column, n: int) -> Column:
    """A point in each of the first n of these parts."""
    return F.slice(g.let(F.transform(F.slice(g.polygon_parts(gaps), 1, n), g.interior_point), once), 1, n)
