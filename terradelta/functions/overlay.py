"""Boolean operations on polygons: difference, union, intersection, and repair of crossed rings.

All geometries of an Arrow batch are worked on together, as flat arrays of edges on a grid of whole numbers: edges are split where they meet, each
piece is labelled with the winding numbers of both inputs above and below it, pieces that separate inside from outside are kept, and these are
traced into rings by the next edge at each vertex. Nothing loops over rows.

A geometry that is made of nested lambdas in the same select can't be an argument (Spark doesn't find the function again): select it as a column first,
and use the result in a later select.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))

#: Corners are rounded to this; coordinates are taken from each row's first point, so it may be far below their own resolution.
GRID = 1e-6
#: Rounds of splitting. Rounding a crossing moves an edge by less than a step of the grid, so later rounds find hardly anything.
ROUNDS = 6


@dataclass
class Points:
    """All points of a batch: their row, their ring, and whether the ring is a shell."""

    row: np.ndarray
    ring: np.ndarray
    shell: np.ndarray
    x: np.ndarray
    y: np.ndarray


def _lengths(a: pa.Array) -> np.ndarray:
    return pc.list_value_length(a).fill_null(0).to_numpy().astype(np.int64)


def points(geometry: pa.Array) -> Points:
    """The points of a geometry column; a null geometry has none."""
    if isinstance(geometry, pa.ChunkedArray):
        geometry = geometry.combine_chunks()
    polygons = geometry.flatten()
    rings = polygons.flatten()
    pts = rings.flatten()
    rows = np.repeat(np.arange(len(geometry)), _lengths(geometry))
    n = _lengths(polygons)
    first = np.zeros(int(n.sum()), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    size = _lengths(rings)
    x, y = (np.asarray(pc.struct_field(pts, k).to_numpy(zero_copy_only=False), float) for k in "xy")
    return Points(np.repeat(np.repeat(rows, n), size), np.repeat(np.arange(len(rings)), size), np.repeat(first, size), x, y)


def _ring_spans(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of one ring."""
    last = np.flatnonzero(np.append(ring[1:] != ring[:-1], True)) if len(ring) else np.zeros(0, np.int64)
    return np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last, last


def _following(ring: np.ndarray) -> np.ndarray:
    """The place after each one in its ring; the last one's is the first."""
    first, last = _ring_spans(ring)
    out = np.arange(len(ring)) + 1
    out[last] = first
    return out


def _sums(ring: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each place's sum of values over its ring."""
    first, last = _ring_spans(ring)
    if not len(first):
        return values
    return np.repeat(np.add.reduceat(values, first), last - first + 1)


def origins(n: int, *layers: Points) -> np.ndarray:
    """(n, 2): the first point of each row in any layer, rounded to whole numbers."""
    out = np.zeros((n, 2))
    for p in reversed(layers):
        rows, first = np.unique(p.row, return_index=True)
        out[rows] = np.rint(np.stack([p.x[first], p.y[first]], axis=1))
    return out


@dataclass
class Edges:
    """Directed edges on the grid, the inside to their left; layer tells the inputs apart."""

    row: np.ndarray
    layer: np.ndarray
    a: np.ndarray  # (n, 2) whole numbers
    b: np.ndarray

    def take(self, which: np.ndarray) -> Edges:
        return Edges(self.row[which], self.layer[which], self.a[which], self.b[which])


def edges(p: Points, layer: int, origin: np.ndarray) -> Edges:
    """The rings' edges, shells counter-clockwise and holes clockwise by their signed area, whatever their direction was."""
    at = np.rint((np.stack([p.x, p.y], axis=1) - origin[p.row]) / GRID).astype(np.int64) if len(p.row) else np.zeros((0, 2), np.int64)
    to = at[_following(p.ring)] if len(at) else at
    first, last = _ring_spans(p.ring)
    near = (at - np.repeat(at[first], last - first + 1, axis=0)).astype(float) if len(at) else at.astype(float)
    after = near[_following(p.ring)] if len(at) else near
    turn = _sums(p.ring, near[:, 0] * after[:, 1] - after[:, 0] * near[:, 1])
    swap = ((turn < 0) == p.shell)[:, None]
    out = Edges(p.row, np.full(len(p.row), layer), np.where(swap, to, at), np.where(swap, at, to))
    return out.take((out.a != out.b).any(axis=1))


def joined(parts: list[Edges]) -> Edges:
    return Edges(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("row", "layer", "a", "b")))


def _hits(row: np.ndarray, low: np.ndarray, high: np.ndarray, of_row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (interval, value) of one row with low <= value <= high. Only pairs that are given out are made."""
    if not len(row) or not len(of_row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = min(low.min(), at.min())
    width = max(high.max(), at.max()) - least + 1
    order = np.lexsort((at, of_row))
    keys = of_row[order] * width + (at[order] - least)
    a = np.searchsorted(keys, row * width + (low - least))
    b = np.searchsorted(keys, row * width + (high - least), "right")
    count = np.maximum(b - a, 0)
    first = np.repeat(a - (np.cumsum(count) - count), count)
    return np.repeat(np.arange(len(row)), count), order[first + np.arange(len(first))]


def _meeting(e: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges of one row whose bounds meet, each pair once: each edge takes those that begin within its width."""
    low, high = np.minimum(e.a, e.b) - 1, np.maximum(e.a, e.b) + 1
    i, j = _hits(e.row, low[:, 0], high[:, 0], e.row, low[:, 0])
    once = (low[i, 0] < low[j, 0]) | ((low[i, 0] == low[j, 0]) & (i < j))
    near = once & (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
    return i[near], j[near]


def _cuts(e: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Edges and the points where they are to be split: crossings, and ends of others that lie on them."""
    i, j = _meeting(e)
    out_edge, out_point = [], []

    def ends(edge: np.ndarray, point: np.ndarray) -> None:
        d = (e.b[edge] - e.a[edge]).astype(float)
        v = (point - e.a[edge]).astype(float)
        length = np.hypot(d[:, 0], d[:, 1])
        along, off = (v * d).sum(axis=1) / length, np.abs(v[:, 0] * d[:, 1] - v[:, 1] * d[:, 0]) / length
        new = (off < 0.75) & (along > 0) & (along < length) & (point != e.a[edge]).any(axis=1) & (point != e.b[edge]).any(axis=1)
        out_edge.append(edge[new])
        out_point.append(point[new])

    for one, other in ((i, j), (j, i)):
        ends(one, e.a[other])
        ends(one, e.b[other])
    r, s = (e.b[i] - e.a[i]).astype(float), (e.b[j] - e.a[j]).astype(float)
    q = (e.a[j] - e.a[i]).astype(float)
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (q[:, 0] * s[:, 1] - q[:, 1] * s[:, 0]) / cross, (q[:, 0] * r[:, 1] - q[:, 1] * r[:, 0]) / cross
    hit = np.flatnonzero((cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
    point = np.rint(e.a[i[hit]] + t[hit, None] * r[hit]).astype(np.int64)
    for one in (i[hit], j[hit]):
        new = (point != e.a[one]).any(axis=1) & (point != e.b[one]).any(axis=1)
        out_edge.append(one[new])
        out_point.append(point[new])
    return np.concatenate(out_edge), np.concatenate(out_point)


def split(e: Edges) -> Edges:
    """The edges in pieces that meet at their ends only."""
    for _ in range(ROUNDS):
        which, point = _cuts(e)
        if not len(which):
            break
        n = len(e.row)
        of = np.concatenate([np.arange(n), which, np.arange(n)])
        at = np.concatenate([e.a, point, e.b])
        d = (e.b - e.a).astype(float)
        along = np.concatenate([np.full(n, -np.inf), ((point - e.a[which]) * d[which]).sum(axis=1), np.full(n, np.inf)])
        order = np.lexsort((along, of))
        of, at = of[order], at[order]
        piece = np.flatnonzero((of[1:] == of[:-1]) & (at[1:] != at[:-1]).any(axis=1))
        e = Edges(e.row[of[piece]], e.layer[of[piece]], at[piece], at[piece + 1])
    return e


def merged(e: Edges, layers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each piece once, from its lesser end to its greater: row, ends, and by how much each layer's winding number is higher to its left."""
    back = (e.a[:, 0] > e.b[:, 0]) | ((e.a[:, 0] == e.b[:, 0]) & (e.a[:, 1] > e.b[:, 1]))
    p, q = np.where(back[:, None], e.b, e.a), np.where(back[:, None], e.a, e.b)
    order = np.lexsort((q[:, 1], q[:, 0], p[:, 1], p[:, 0], e.row))
    row, p, q, layer, sign = e.row[order], p[order], q[order], e.layer[order], np.where(back, -1, 1)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (p[1:] != p[:-1]).any(axis=1) | (q[1:] != q[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    n = int(new.sum())
    rise = np.stack([np.bincount(group, np.where(layer == k, sign, 0), n) for k in range(layers)], axis=1).astype(np.int64)
    some = (rise != 0).any(axis=1)
    return row[new][some], p[new][some], q[new][some], rise[some]


def windings(row: np.ndarray, p: np.ndarray, q: np.ndarray, rise: np.ndarray) -> np.ndarray:
    """Each layer's winding number just to the left of each piece: what the pieces straight above its middle add up to.

    For an upright piece that is just left of its middle. Places are doubled, so that middles are whole numbers.
    """
    middle = p + q
    upright = p[:, 0] == q[:, 0]
    out = np.zeros_like(rise)
    low, high = 2 * p[:, 0], 2 * q[:, 0]
    for which, a, b in ((~upright, low, high - 1), (upright, low + 1, high)):
        chosen = np.flatnonzero(which)
        other = np.flatnonzero(~upright)
        g, e = _hits(row[other], a[other], b[other], row[chosen], middle[chosen, 0])
        g, e = other[g], chosen[e]
        run = (q[g, 0] - p[g, 0]).astype(float)
        height = 2.0 * p[g, 1] + (middle[e, 0] - 2 * p[g, 0]) * (q[g, 1] - p[g, 1]) / run
        above = (height > middle[e, 1]) & (g != e)
        for k in range(rise.shape[1]):
            out[:, k] -= np.bincount(e[above], rise[g[above], k], len(row)).astype(np.int64)
    return out


def boundary(e: Edges, inside, layers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed pieces (row, from, to) with the result to their left. inside: whether winding numbers, one column a layer, are in the result."""
    row, p, q, rise = merged(split(e), layers)
    left = windings(row, p, q, rise)
    a, b = inside(left), inside(left - rise)
    kept = a != b
    turn = (b & ~a)[:, None]
    return row[kept], np.where(turn, q, p)[kept], np.where(turn, p, q)[kept]


def trace(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of directed edges: row, ring and place of each corner, in order.

    At each vertex the ring goes on along the first edge clockwise from where it came, so parts that touch in a point are rings of their own.
    """
    n = len(row)
    if not n:
        return row, row, a
    order = np.lexsort((a[:, 1], a[:, 0], row))
    new = np.ones(n, bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (a[order][1:] != a[order][:-1]).any(axis=1)
    vertex = np.empty(n, np.int64)
    vertex[order] = np.cumsum(new) - 1
    spots = order[new]  # an edge that leaves each vertex
    angle = lambda d: np.arctan2(d[:, 1].astype(float), d[:, 0].astype(float)) + np.pi
    leaving = np.lexsort((angle(b - a), vertex))
    keys = vertex[leaving] * 8.0 + angle(b - a)[leaving]
    begin = np.searchsorted(vertex[leaving], np.arange(len(spots) + 1))
    # the vertex at each edge's end, through the order of vertices
    both = np.lexsort((np.concatenate([np.zeros(len(spots)), np.ones(n)]), *(np.concatenate([a[spots][:, k], b[:, k]]) for k in (1, 0)), np.concatenate([row[spots], row])))
    is_spot = both < len(spots)
    end = np.empty(n, np.int64)
    end[both[~is_spot] - len(spots)] = (np.cumsum(is_spot) - 1)[~is_spot]
    place = np.searchsorted(keys, end * 8.0 + angle(a - b)) - 1
    place = np.where(place < begin[end], begin[end + 1] - 1, place)
    following = leaving[place]
    # least edge of each ring, then each edge's steps to it
    label, jump = np.arange(n), following.copy()
    steps = int(np.ceil(np.log2(n + 1))) + 1
    for _ in range(steps):
        label = np.minimum(label, label[jump])
        jump = jump[jump]
    root = label == np.arange(n)
    away, jump = np.where(root, 0, 1), np.where(root, np.arange(n), following)
    for _ in range(steps):
        away += away[jump]
        jump = jump[jump]
    size = np.bincount(label, minlength=n)
    order = np.lexsort(((size[label] - away) % size[label], label, row))
    return row[order], label[order], a[order]


def _apart(row: np.ndarray, ring: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ring numbers in which a ring that comes back to a corner (a hole that touches its shell) is cut into simple ones; such rings are few."""
    order = np.lexsort((at[:, 1], at[:, 0], ring))
    again = (ring[order][1:] == ring[order][:-1]) & (at[order][1:] == at[order][:-1]).all(axis=1)
    ring = ring.copy()
    free = int(ring.max()) + 1 if len(ring) else 0
    for r in np.unique(ring[order][1:][again]):
        stack: list[int] = []
        seen: dict[tuple, int] = {}
        for i in np.flatnonzero(ring == r).tolist():
            key = tuple(at[i])
            if key in seen:
                first = seen[key]
                loop = stack[first:]
                del stack[first:]
                for k in loop:
                    seen.pop(tuple(at[k]), None)
                ring[loop] = free
                free += 1
            seen[key] = len(stack)
            stack.append(i)
    return ring


@dataclass
class Rings:
    """Simple rings, corner by corner, shells counter-clockwise; owner is the shell of each ring."""

    row: np.ndarray
    ring: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    size: np.ndarray  # signed area of the ring, in squares of the grid


def rings(row: np.ndarray, ring: np.ndarray, at: np.ndarray) -> Rings:
    """Numbered anew, without corners in a straight line and rings without area, and each hole with the least shell around it."""
    ring = _apart(row, ring, at)
    order = np.argsort(ring, kind="stable")
    row, ring, at = row[order], ring[order], at[order]
    for _ in range(2):
        if not len(ring):
            break
        nxt = _following(ring)
        d = at[nxt] - at
        before = np.empty_like(d)
        before[nxt] = d
        bend = before[:, 0] * d[:, 1] != before[:, 1] * d[:, 0]
        row, ring, at = row[bend], ring[bend], at[bend]
    if not len(ring):
        return Rings(row, ring, at, ring, np.zeros(0))
    _, ring = np.unique(ring, return_inverse=True)
    nxt, (first, last) = _following(ring), _ring_spans(ring)
    near = (at - np.repeat(at[first], last - first + 1, axis=0)).astype(float)
    size = np.add.reduceat(near[:, 0] * near[nxt][:, 1] - near[nxt][:, 0] * near[:, 1], first) / 2
    owner = np.where(size > 0, np.arange(len(size)), -1)
    holes, shells = np.flatnonzero(size < 0), np.flatnonzero(size > 0)
    if len(holes):
        # straight above the middle of a hole's first edge, the shells around it have an odd number of edges
        middle = at[first[holes]] + at[nxt[first[holes]]]
        x, y = middle[:, 0], middle[:, 1]
        a, b = at, at[nxt]
        side = np.flatnonzero((a[:, 0] != b[:, 0]) & (size[ring] > 0))
        low, high = 2 * np.minimum(a[side, 0], b[side, 0]), 2 * np.maximum(a[side, 0], b[side, 0]) - 1
        g, h = _hits(row[side], low, high, row[first[holes]], x)
        g = side[g]
        height = 2.0 * a[g, 1] + (x[h] - 2 * a[g, 0]) * (b[g, 1] - a[g, 1]) / (b[g, 0] - a[g, 0]).astype(float)
        above = height > y[h]
        pair = h[above] * len(size) + ring[g[above]]
        pairs, count = np.unique(pair, return_counts=True)
        around = pairs[count % 2 == 1]
        h, s = around // len(size), around % len(size)
        order = np.lexsort((size[s], h))
        hit, least = np.unique(h[order], return_index=True)
        owner[holes[hit]] = s[order][least]
    return Rings(row, ring, at, owner, size)


def to_arrow(r: Rings, origin: np.ndarray, n: int, kind: pa.DataType, grid: float = GRID) -> pa.Array:
    """Polygons of each row, the largest first; equal ones by their place."""
    first, last = _ring_spans(r.ring)
    count = last - first + 1 if len(first) else np.zeros(0, np.int64)
    rows = r.row[first] if len(first) else np.zeros(0, np.int64)
    good = r.owner >= 0
    area = np.bincount(r.owner[good], r.size[good], len(r.size)) if len(r.size) else np.zeros(0)
    corner = np.minimum.reduceat(r.at, first) if len(first) else np.zeros((0, 2), np.int64)
    own = r.owner[good]
    order = np.flatnonzero(good)[np.lexsort((corner[good][:, 1], corner[good][:, 0], -r.size[good], (r.size[good] < 0), own, corner[own][:, 1], corner[own][:, 0], -np.round(area[own], 3), rows[good]))]
    # each ring closes with its first corner
    size = count[order] + 1
    begin = np.cumsum(size) - size
    index = np.repeat(first[order], size) + (np.arange(int(size.sum())) - np.repeat(begin, size))
    index[begin + size - 1] = first[order]
    at = r.at[index] * grid + origin[r.row[index]] if len(index) else np.zeros((0, 2))
    shell = np.flatnonzero(r.size[order] > 0)
    per_polygon = np.diff(np.append(shell, len(order)))
    per_row = np.bincount(rows[order][shell], minlength=n)
    ends = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
    pts = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(ends(per_row), pa.ListArray.from_arrays(ends(per_polygon), pa.ListArray.from_arrays(ends(size), pts))).cast(kind)


KIND = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _made(layers: list[pa.Array], inside) -> pa.Array:
    n = len(layers[0])
    pts = [points(g) for g in layers]
    origin = origins(n, *pts)
    e = joined([edges(p, k, origin) for k, p in enumerate(pts)])
    return to_arrow(rings(*trace(*boundary(e, inside, len(layers)))), origin, n, KIND)


@F.arrow_udf(GEOMETRY)
def _difference(a: pa.Array, b: pa.Array) -> pa.Array:
    return _made([a, b], lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0))


@F.arrow_udf(GEOMETRY)
def _intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    return _made([a, b], lambda w: (w[:, 0] > 0) & (w[:, 1] > 0))


@F.arrow_udf(GEOMETRY)
def _union(a: pa.Array, b: pa.Array) -> pa.Array:
    return _made([a, b], lambda w: (w[:, 0] > 0) | (w[:, 1] > 0))


@F.arrow_udf(GEOMETRY)
def _repaired(a: pa.Array) -> pa.Array:
    return _made([a], lambda w: w[:, 0] > 0)


def hulls(p: Points) -> Points:
    """The convex hull of each row: points in order of place, of which those go that lie above their neighbours, again and again; then below."""
    every = np.unique(np.stack([p.row, p.x, p.y], axis=1), axis=0)  # in order of row and place, each once
    parts = []
    for sign in (1, -1):
        row, x, y = every[:, 0].astype(np.int64), every[:, 1], every[:, 2]
        while len(row) > 2:
            turn = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (x[2:] - x[:-2]) * (y[1:-1] - y[:-2])
            same = (row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])
            keep = np.concatenate([[True], ~(same & (sign * turn <= 0)), [True]])
            if keep.all():
                break
            row, x, y = row[keep], x[keep], y[keep]
        parts.append((row, x, y) if sign > 0 else (row[::-1], x[::-1], y[::-1]))
    side = np.repeat([0, 1], [len(q[0]) for q in parts])
    row, x, y = (np.concatenate([q[k] for q in parts]) for k in range(3))
    order = np.lexsort((np.arange(len(row)), side, row))
    row, x, y = row[order], x[order], y[order]
    return Points(row, row, np.ones(len(row), bool), x, y)


@F.arrow_udf(GEOMETRY)
def _hull_gaps(a: pa.Array) -> pa.Array:
    p = points(a)
    origin = origins(len(a), p)
    e = joined([edges(hulls(p), 0, origin), edges(p, 1, origin)])
    return to_arrow(rings(*trace(*boundary(e, lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0), 2))), origin, len(a), KIND)


def hull_gaps(a: Column) -> Column:
    """The parts of the convex hull outside the geometry, the largest first."""
    return F.when(a.isNotNull(), _hull_gaps(a))


#: Pairs of edges that meet at once.
BLOCK = 1 << 20


def _strips(g: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Points]:
    """First edge and number of edges of each row that aren't upright, and each edge as (x0, y0, x1, y1, sign): sign 1 if the shape lies below it."""
    p = points(g)
    n = len(g)
    if not len(p.row):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((0, 5)), p
    to, (first, last) = _following(p.ring), _ring_spans(p.ring)
    x, y = p.x - np.repeat(p.x[first], last - first + 1), p.y - np.repeat(p.y[first], last - first + 1)
    turn = np.sign(_sums(p.ring, x * y[to] - x[to] * y)) * np.where(p.shell, 1, -1)
    right = p.x[to] > p.x
    a = np.where(right[:, None], np.stack([p.x, p.y], axis=1), np.stack([p.x[to], p.y[to]], axis=1))
    b = np.where(right[:, None], np.stack([p.x[to], p.y[to]], axis=1), np.stack([p.x, p.y], axis=1))
    slant = p.x[to] != p.x
    begin = np.searchsorted(p.row[slant], np.arange(n + 1))
    return begin[:-1], np.diff(begin), np.concatenate([a, b, np.where(right, -turn, turn)[:, None]], axis=1)[slant], p


def common_areas(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The area that both geometries of each row have in common, without an overlay.

    A shape is the signed sum of the strips below its edges, so this is the sum over pairs of edges of the area below both: the integral of the
    lower one where they stand above each other.
    """
    (fa, na, ea, pa_), (fb, nb, eb, _) = _strips(a), _strips(b)
    origin = origins(len(a), pa_)
    size = na * nb
    out = np.zeros(len(a))
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        row = np.repeat(np.arange(at, upto), size[at:upto])
        k = np.arange(len(row)) - np.repeat(ends[at:upto] - size[at:upto] - (ends[at - 1] if at else 0), size[at:upto])
        base = np.concatenate([origin, origin, np.zeros((len(a), 1))], axis=1)[row]
        e, f = ea[fa[row] + k // np.maximum(nb[row], 1)] - base, eb[fb[row] + k % np.maximum(nb[row], 1)] - base
        u, v = np.maximum(e[:, 0], f[:, 0]), np.minimum(e[:, 2], f[:, 2])
        on = u < v
        e, f, u, v, row = e[on], f[on], u[on], v[on], row[on]
        height = lambda g, x: g[:, 1] + (x - g[:, 0]) * (g[:, 3] - g[:, 1]) / (g[:, 2] - g[:, 0])
        eu, ev, fu, fv = height(e, u), height(e, v), height(f, u), height(f, v)
        p, q = eu - fu, ev - fv
        with np.errstate(invalid="ignore", divide="ignore"):
            between = np.where(p * q < 0, np.abs(p * q) / (np.abs(p) + np.abs(q)) / 2, 0.0)
        mean = (np.minimum(eu, fu) + np.minimum(ev, fv)) / 2 + between
        out += np.bincount(row, e[:, 4] * f[:, 4] * (v - u) * mean, len(a))
        at = upto
    return np.maximum(out, 0.0)


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("size", "x", "y")]))
def _sizes(a: pa.Array) -> pa.Array:
    p, n = points(a), len(a)
    origin = origins(n, p)
    x, y, to = p.x - origin[p.row, 0], p.y - origin[p.row, 1], _following(p.ring)
    cross = x * y[to] - x[to] * y
    cross *= np.sign(_sums(p.ring, cross)) * np.where(p.shell, 1, -1)
    total = lambda v: np.bincount(p.row, v, n)
    size = total(cross) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = [np.where(size > 0, total((v + v[to]) * cross) / 6 / size + origin[:, k], np.nan) for k, v in enumerate((x, y))]
    return pa.StructArray.from_arrays([pa.array(size), *(pa.array(v, from_pandas=True) for v in middle)], names=["size", "x", "y"])


def size_and_middle(a: Column) -> Column:
    """Struct (size, x, y): area and centroid, as geometry.area and geometry.centroid have them, in one pass; null where the geometry is."""
    return F.when(a.isNotNull(), _sizes(a))


@F.arrow_udf(T.DoubleType())
def _common_area(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(common_areas(a, b))


def common_area(a: Column, b: Column) -> Column:
    """Area that two geometries have in common; 0 where one is null. It is worked out once for each row, wherever it is used."""
    return _common_area.asNondeterministic()(a, b)


def difference(a: Column, b: Column) -> Column:
    """The parts of a outside b, the largest first; empty where nothing is left, null where a is. A null b takes nothing away."""
    return F.when(a.isNotNull(), _difference(a, b))


def intersection(a: Column, b: Column) -> Column:
    """The parts that a and b have in common; null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), _intersection(a, b))


def union(a: Column, b: Column) -> Column:
    """The parts of a and b together, where they touch along an edge in one; null where both are."""
    return F.when(a.isNotNull() | b.isNotNull(), _union(a, b))


def repaired(a: Column) -> Column:
    """A valid geometry: crossed rings are split and what they wind around in their own direction stays; overlapping parts become one.

    Of a ring that crosses itself like an 8 the larger lobe stays, as a buffer of width 0 has it.
    """
    return F.when(a.isNotNull(), _repaired(a))
