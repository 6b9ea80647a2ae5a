"""Image masks as run-length columns, and what is done with them.

A mask is array<struct<y,x0,x1>>: stretches of pixels x0 to x1 of line y, in order, none touching another of its line. Measures are Column expressions
over the runs; filling, set operations, parts and outlines work on all masks of an Arrow batch at once, as intervals on one long line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import overlay

RUNS = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType()) for k in ("y", "x0", "x1")]))
KIND = pa.list_(pa.struct([(k, pa.int32()) for k in ("y", "x0", "x1")]))
#: No image has more lines or columns, so a row's pixels have numbers of their own: row, line and column in one number.
SIDE = 1 << 16


# Column expressions ------------------------------------------------------------------------------------------


def pixels(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda s, r: s + r["x1"] - r["x0"] + 1)


def bounds(mask: Column) -> Column:
    """First and last columns and lines; null for an empty mask."""
    least = lambda k: F.array_min(F.transform(mask, lambda r: r[k]))
    most = lambda k: F.array_max(F.transform(mask, lambda r: r[k]))
    return F.when(F.size(mask) > 0, F.struct(least("x0").alias("x0"), least("y").alias("y0"), most("x1").alias("x1"), most("y").alias("y1")))


def centroid(mask: Column) -> Column:
    """The mean pixel; null for an empty mask."""
    n = lambda r: (r["x1"] - r["x0"] + 1).cast("double")
    total = lambda of: F.aggregate(mask, F.lit(0.0), lambda s, r: s + of(r))
    size = pixels(mask)
    return F.when(F.size(mask) > 0, F.struct((total(lambda r: n(r) * (r["x0"] + r["x1"]) / 2) / size).alias("x"), (total(lambda r: n(r) * r["y"]) / size).alias("y")))


def iou(a: Column, b: Column) -> Column:
    """Common pixels against all of both; 0 where neither has any."""
    common = pixels(intersection(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), pixels(a) + pixels(b) - common), F.lit(0.0))


# intervals on one line ---------------------------------------------------------------------------------------


@dataclass
class Runs:
    """Intervals [start, end) of pixel numbers."""

    start: np.ndarray
    end: np.ndarray


def _number(row: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (row.astype(np.int64) * SIDE + y) * SIDE + x


def _parted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line and column of pixel numbers."""
    return at // (SIDE * SIDE), at // SIDE % SIDE, at % SIDE


def swept(layers: list[Runs], inside) -> Runs:
    """Where inside(counts, one column a layer) holds, in order, intervals that touch in one."""
    at = np.concatenate([x for r in layers for x in (r.start, r.end)])
    if not len(at):
        return Runs(at.astype(np.int64), at.astype(np.int64))
    change = np.zeros((len(at), len(layers)), np.int64)
    k = 0
    for i, r in enumerate(layers):
        change[k : k + len(r.start), i] = 1
        k += len(r.start)
        change[k : k + len(r.end), i] = -1
        k += len(r.end)
    order = np.argsort(at, kind="stable")
    at = at[order]
    count = np.cumsum(change[order], axis=0)
    last = np.append(at[1:] != at[:-1], True)
    at, state = at[last], inside(count[last])
    before = np.append(False, state[:-1])
    return Runs(at[state & ~before], at[~state & before])


def merged(r: Runs) -> Runs:
    return swept([r], lambda n: n[:, 0] > 0)


def runs_of(mask: pa.Array) -> Runs:
    if isinstance(mask, pa.ChunkedArray):
        mask = mask.combine_chunks()
    row = np.repeat(np.arange(len(mask)), pc.list_value_length(mask).fill_null(0).to_numpy())
    flat = mask.flatten()
    y, a, b = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("y", "x0", "x1"))
    return Runs(_number(row, y, a), _number(row, y, b) + 1)


def to_arrow(r: Runs, n: int) -> pa.Array:
    row, y, a = _parted(r.start)
    b = r.end - r.start + a - 1
    ends = np.searchsorted(row, np.arange(n + 1))
    each = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (y, a, b)], names=["y", "x0", "x1"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)


# filling -----------------------------------------------------------------------------------------------------


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: each index c times, and 0 .. c - 1 for each."""
    first = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(count)), count), np.arange(len(first)) - first


def _ring_runs(row: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> Runs:
    """Pixels inside rings with whole-number corners (even-odd) or on their edges, within each row's image."""
    to = overlay._following(ring)
    dx, dy = x[to] - x, y[to] - y
    # edges, pixel by pixel along their longer side; a middle between two pixels goes to the greater one
    steps = np.maximum(np.abs(dx), np.abs(dy))
    e, t = _spread(steps + 1)
    n = np.maximum(steps[e], 1)
    px, py = ((2 * (v[e] * n + d[e] * t) + n) // (2 * n) for v, d in ((x, dx), (y, dy)))
    on = (px >= 0) & (py >= 0) & (px < width[row[e]]) & (py < height[row[e]])
    start = _number(row[e], py, px)[on]
    # lines through the inside: crossings of each line in order, in pairs
    up = np.flatnonzero(dy != 0)
    low, high = np.minimum(y[up], y[to[up]]), np.maximum(y[up], y[to[up]])
    low, high = np.maximum(low, 0), np.minimum(high, height[row[up]])
    e, t = _spread(np.maximum(high - low, 0))
    at = low[e] + t
    e = up[e]
    cross = x[e] + (at - y[e]) * (dx[e] / dy[e])
    order = np.lexsort((cross, at, ring[e]))
    e, at, cross = e[order], at[order], cross[order]
    a, b = np.ceil(cross[0::2] - 1e-9).astype(np.int64), np.floor(cross[1::2] + 1e-9).astype(np.int64)
    r, at = row[e[0::2]], at[0::2]
    a, b = np.maximum(a, 0), np.minimum(b, width[r] - 1)
    full = a <= b
    return merged(Runs(np.concatenate([start, _number(r, at, a)[full]]), np.concatenate([start + 1, _number(r, at, b)[full] + 1])))


def filled(geometry: pa.Array, width: pa.Array, height: pa.Array) -> Runs:
    """Rings in their order, each with its corners rounded to whole numbers: shells set the pixels inside and on their edge, holes clear theirs."""
    p = overlay.points(geometry)
    wide, high = (np.minimum(v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), SIDE - 1) for v in (width, height))
    out = Runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(p.row):
        return out
    x, y = np.rint(p.x).astype(np.int64), np.rint(p.y).astype(np.int64)
    first, last = overlay._ring_spans(p.ring)
    rows = p.row[first]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    nth = np.repeat(nth, last - first + 1)
    for k in range(int(nth.max()) + 1):
        for shell in (True, False):
            chosen = (nth == k) & (p.shell == shell)
            if chosen.any():
                new = _ring_runs(p.row[chosen], p.ring[chosen], x[chosen], y[chosen], wide, high)
                out = swept([out, new], (lambda n: (n > 0).any(axis=1)) if shell else (lambda n: (n[:, 0] > 0) & (n[:, 1] == 0)))
    return out


def dilated(r: Runs, radius: int, width: np.ndarray, height: np.ndarray) -> Runs:
    """Pixels of the image at most `radius` lines and columns away."""
    row, y, a = _parted(r.start)
    b = r.end - r.start + a
    low, high = np.maximum(y - radius, 0), np.minimum(y + radius, height[row] - 1)
    e, t = _spread(np.maximum(high - low + 1, 0))
    line = _number(row[e], low[e] + t, np.zeros(len(e), np.int64))
    return merged(Runs(line + np.maximum(a[e] - radius, 0), line + np.minimum(b[e] + radius, width[row[e]])))


# parts and outlines ------------------------------------------------------------------------------------------


def components(r: Runs) -> np.ndarray:
    """A number for each run, equal for runs that hang together over edges of pixels (not over corners)."""
    n = len(r.start)
    label = np.arange(n)
    low = np.searchsorted(r.end, r.start + SIDE, "right")  # runs of the next line that share a column
    high = np.searchsorted(r.start, r.end + SIDE, "left")
    u, t = _spread(np.maximum(high - low, 0))
    v = low[u] + t
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def largest(r: Runs) -> Runs:
    """The part of most pixels in each row; of equal ones the first."""
    if not len(r.start):
        return r
    label = components(r)
    size = np.bincount(label, r.end - r.start, len(label))
    roots = np.flatnonzero(size)
    row = r.start[roots] // (SIDE * SIDE)
    order = np.lexsort((roots, -size[roots], row))
    best = roots[order][np.append(True, row[order][1:] != row[order][:-1])]
    keep = np.isin(label, best)
    return Runs(r.start[keep], r.end[keep])


def outline(r: Runs, n: int) -> pa.Array:
    """Polygons along the edges of pixels, the largest first; parts that touch at a corner are polygons of their own."""
    lone = lambda by: swept([r, Runs(r.start + by, r.end + by)], lambda c: (c[:, 0] > 0) & (c[:, 1] == 0))
    bottom, top = lone(SIDE), lone(-SIDE)
    row, y, a = _parted(r.start)
    b = r.end - r.start + a
    rb, yb, ab = _parted(bottom.start)
    rt, yt, at = _parted(top.start)
    bb, bt = bottom.end - bottom.start + ab, top.end - top.start + at
    point = lambda x, y: np.stack([x, y], axis=1)
    rows = np.concatenate([rb, row, rt, row])
    start = np.concatenate([point(ab, yb), point(b, y), point(bt, yt + 1), point(a, y + 1)])
    end = np.concatenate([point(bb, yb), point(b, y + 1), point(at, yt + 1), point(a, y)])
    made = overlay.rings(*overlay.trace(rows, start, end))
    return overlay.to_arrow(made, np.zeros((n, 2)), n, overlay.KIND, 1.0)


# pixels ------------------------------------------------------------------------------------------------------


def deep_points(r: Runs, n: int, count: np.ndarray, radius: int, width: np.ndarray, height: np.ndarray) -> pa.Array:
    """Up to `count` pixels of each row, always the one farthest from the nearest pixel outside the mask, without those within `radius` of earlier ones.

    Distances are exact and in whole squares: along the line first, then the least over lines above and below, which ends where no line can be
    nearer any more. The image's border is no end of a mask. Of equal pixels the first of the first line is taken.
    """
    if not len(r.start):
        return pa.array([[]] * n, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("d2", pa.int64())])))
    far = 1 << 40
    e, t = _spread(r.end - r.start)
    at = r.start[e] + t
    row, y, x = _parted(at)
    first = r.start[e] % SIDE
    left = np.where(first == 0, far, t + 1)
    right = np.where(first + (r.end - r.start)[e] == width[row], far, r.end[e] - at)
    line = np.minimum(np.minimum(left, right), SIDE) ** 2
    line[(left == far) & (right == far)] = far
    best, k = line.copy(), 1
    while True:
        open_ = np.flatnonzero((best > k * k) & ((y + k < height[row]) | (y - k >= 0)))
        if not len(open_):
            break
        for side in (-k, k):
            here = open_[(y[open_] + side >= 0) & (y[open_] + side < height[row[open_]])]
            place = np.minimum(np.searchsorted(at, at[here] + side * SIDE), len(at) - 1)
            there = np.where(at[place] == at[here] + side * SIDE, line[place], 0)
            best[here] = np.minimum(best[here], there + k * k)
        k += 1
    rows, spans = np.unique(row, return_index=True)
    size = np.diff(np.append(spans, len(row)))
    work = best.copy()
    found = [np.full(n, -1)]
    for turn in range(int(count.max(initial=0))):
        most = np.maximum.reduceat(work, spans)
        hit = np.flatnonzero(work == np.repeat(most, size))
        chosen = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        good = (work[chosen] > 0) & (count[rows] > turn)
        pick = np.full(n, -1)
        pick[rows[good]] = chosen[good]
        found.append(pick)
        c = np.repeat(chosen, size)
        near = (x - x[c]) ** 2 + (y - y[c]) ** 2 <= radius * radius
        work[near] = 0
    picks = np.stack(found[1:], axis=1) if len(found) > 1 else np.zeros((n, 0), np.int64)
    flat = picks[picks >= 0]
    ends = np.concatenate([[0], np.cumsum((picks >= 0).sum(axis=1))]).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(x[flat].astype(np.int32)), pa.array(y[flat].astype(np.int32)), pa.array(np.where(best[flat] >= far, -1, best[flat]))], names=["x", "y", "d2"])
    return pa.ListArray.from_arrays(pa.array(ends), each)


def grey_measures(image: pa.Array, width: np.ndarray, mask: Runs, ring: Runs, below: float) -> dict[str, np.ndarray]:
    """Mean, population deviation, share under the mean less `below`, mean of the ring, and ring less mask; NaN where there are no pixels."""
    n = len(image)
    wide = image.fill_null(b"").cast(pa.large_binary())
    data, ends = np.frombuffer(wide.buffers()[2] or b"", np.uint8), np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1]

    def values(r: Runs) -> tuple[np.ndarray, np.ndarray]:
        e, t = _spread(r.end - r.start)
        row, y, x = _parted(r.start[e] + t)
        at = ends[row] + y * width[row] + x
        good = at < ends[row + 1]
        return row[good], data[at[good]].astype(float)

    with np.errstate(invalid="ignore", divide="ignore"):
        row, v = values(mask)
        size = np.bincount(row, minlength=n)
        mean = np.bincount(row, v, n) / size
        deviation = np.sqrt(np.bincount(row, (v - mean[row]) ** 2, n) / size)
        dark = np.bincount(row, v < mean[row] - below, n) / size
        row, v = values(ring)
        around = np.bincount(row, v, n) / np.bincount(row, minlength=n)
    return {"mean": mean, "deviation": deviation, "dark": dark, "ring_mean": around, "drop": around - mean}


# functions of columns ----------------------------------------------------------------------------------------


def _ints(a: pa.Array) -> np.ndarray:
    return a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(RUNS)
def _filled(geometry: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return to_arrow(filled(geometry, width, height), len(geometry))


@F.arrow_udf(RUNS)
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    return to_arrow(swept([runs_of(a), runs_of(b)], lambda n: (n > 0).all(axis=1)), len(a))


@F.arrow_udf(RUNS)
def _either(a: pa.Array, b: pa.Array) -> pa.Array:
    return to_arrow(swept([runs_of(a), runs_of(b)], lambda n: (n > 0).any(axis=1)), len(a))


@F.arrow_udf(RUNS)
def _less(a: pa.Array, b: pa.Array) -> pa.Array:
    return to_arrow(swept([runs_of(a), runs_of(b)], lambda n: (n[:, 0] > 0) & (n[:, 1] == 0)), len(a))


@F.arrow_udf(RUNS)
def _largest(a: pa.Array) -> pa.Array:
    return to_arrow(largest(runs_of(a)), len(a))


@F.arrow_udf(overlay.GEOMETRY)
def _outline(a: pa.Array) -> pa.Array:
    return outline(runs_of(a), len(a))


def fill(geometry: Column, width: Column, height: Column) -> Column:
    """The mask of a geometry in pixel coordinates; null where that is."""
    return F.when(geometry.isNotNull(), _filled(geometry, width, height))


def intersection(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _common(a, b))


def union(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _either(a, b))


def difference(a: Column, b: Column) -> Column:
    """Pixels of a that b lacks: what a prediction misses of its prior, or spills over it."""
    return F.when(a.isNotNull() & b.isNotNull(), _less(a, b))


def dilate(mask: Column, radius: int, width: Column, height: Column) -> Column:
    """Pixels at most radius lines and columns away: n times a square of 2 k + 1 pixels is a radius of n k."""

    @F.arrow_udf(RUNS)
    def grown(a: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return to_arrow(dilated(runs_of(a), radius, _ints(w), _ints(h)), len(a))

    return F.when(mask.isNotNull(), grown(mask, width, height))


def ring(mask: Column, radius: int, width: Column, height: Column) -> Column:
    """Pixels around the mask, not in it."""
    return difference(dilate(mask, radius, width, height), mask)


def largest_part(mask: Column) -> Column:
    return F.when(mask.isNotNull(), _largest(mask))


def polygons(mask: Column) -> Column:
    """The mask as a geometry along the edges of its pixels, largest polygon first."""
    return F.when(mask.isNotNull(), _outline(mask))


def deepest(mask: Column, count: Column, radius: int, width: Column, height: Column) -> Column:
    """Structs (x, y, d2) of up to `count` pixels deepest in the mask, d2 the squared distance to the nearest pixel outside (-1: there is none)."""
    kind = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("d2", T.LongType())]))

    @F.arrow_udf(kind)
    def deep(a: pa.Array, k: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return deep_points(runs_of(a), len(a), _ints(k), radius, _ints(w), _ints(h))

    return F.when(mask.isNotNull(), deep(mask, count, width, height))


def grey(image: Column, width: Column, mask: Column, around: Column, below: float = 12.0) -> Column:
    """Struct (mean, deviation, dark, ring_mean, drop) of an image's grey values, a byte a pixel, under a mask and its ring; nulls without pixels."""
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in ("mean", "deviation", "dark", "ring_mean", "drop")])

    @F.arrow_udf(kind)
    def measured(i: pa.Array, w: pa.Array, m: pa.Array, r: pa.Array) -> pa.Array:
        found = grey_measures(i, _ints(w), runs_of(m), runs_of(r), below)
        return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in found.values()], names=list(found))

    return measured(image, width, mask, around)
