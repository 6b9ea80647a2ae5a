"""Overlay of slanted, concave and holed polygons against points and areas."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry as g
from terradelta.functions import overlay as o


def column(geometries):
    return pa.array([None if x is None else [[[{"x": float(a), "y": float(b)} for a, b in ring] for ring in polygon] for polygon in x] for x in geometries], o.KIND)


def pairs(geometry):
    return [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in geometry]


def closed(ring):
    return [*ring, ring[0]]


def inside(geometry, x, y):
    """Even-odd by crossings to the right."""
    hits = 0
    for polygon in geometry:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                hits += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return hits % 2 == 1


def off_edge(geometry, x, y):
    best = math.inf
    for polygon in geometry:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                dx, dy = bx - ax, by - ay
                t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1)))
                best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def turn(ring):
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)) / 2


def area(geometry):
    return sum(abs(turn(p[0])) - sum(abs(turn(h)) for h in p[1:]) for p in geometry)


def shapes(n, seed):
    """Pairs of valid shapes, some at map coordinates, many with corners and edges in common."""
    r = random.Random(seed)

    def one(off):
        cx, cy = off + r.randrange(10), 15 * off + r.randrange(10)
        kind = r.randrange(4)
        w, h = r.randrange(3, 9), r.randrange(3, 9)
        box = closed([(cx, cy), (cx + w, cy), (cx + w, cy + h), (cx, cy + h)])
        if kind == 0:
            return [[box]] if w < 4 or h < 4 else [[box, closed([(cx + 1, cy + 1), (cx + w - 1, cy + 1), (cx + w - 1, cy + h - 1), (cx + 1, cy + h - 1)])]]
        if kind == 1:
            return [[closed([(cx, cy), (cx + w, cy), (cx + w, cy + 1), (cx + w // 2, cy + 1), (cx + w // 2, cy + h), (cx, cy + h)])]]
        if kind == 2:  # two parts
            return [[box], [closed([(cx + w + 1, cy), (cx + w + 3, cy + 1), (cx + w + 1, cy + 3)])]]
        k = r.randrange(5, 12)
        angles = [(i + r.random() * 0.8) * 2 * math.pi / k for i in range(k)]
        return [[closed([(cx + d * math.cos(a), cy + d * math.sin(a)) for a in angles for d in [r.uniform(2, 7)]])]]

    out = []
    for _ in range(n):
        off = r.choice([0, 383_000])
        out.append((one(off), one(off)))
    return out


def local(geometry):
    """The same near the origin."""
    off = 383_000 if geometry[0][0][0][0] > 100_000 else 0
    return [[[(x - off, y - 15 * off) for x, y in ring] for ring in polygon] for polygon in geometry]


OPERATIONS = {
    "difference": (lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0), lambda a, b: a and not b),
    "intersection": (lambda w: (w[:, 0] > 0) & (w[:, 1] > 0), lambda a, b: a and b),
    "union": (lambda w: (w[:, 0] > 0) | (w[:, 1] > 0), lambda a, b: a or b),
}


def test_overlay():
    cases, r = shapes(300, 3), random.Random(4)
    a, b = column([x for x, _ in cases]), column([y for _, y in cases])
    size = {}
    for name, (wind, truth) in OPERATIONS.items():
        found = [pairs(x) for x in o._made([a, b], wind).to_pylist()]
        size[name] = np.array([area(x) for x in found])
        for (x, y), z in zip(cases, found, strict=True):
            points = [p for polygon in x + y for ring in polygon for p in ring]
            for _ in range(30):
                px, py = (r.uniform(min(v) - 1, max(v) + 1) for v in zip(*points, strict=True))
                if min(off_edge(x, px, py), off_edge(y, px, py)) > 1e-4:
                    assert inside(z, px, py) == truth(inside(x, px, py), inside(y, px, py))
            sizes = [area([p]) for p in z]
            assert all(s >= t - 1e-3 for s, t in zip(sizes, sizes[1:], strict=False))
            for polygon in z:
                assert turn(polygon[0]) > 0 and all(turn(h) < 0 for h in polygon[1:])
                assert all(ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 for ring in polygon)
    first, second = (np.array([area(c[k]) for c in cases]) for k in (0, 1))
    assert np.allclose(size["difference"] + size["intersection"], first, atol=1e-4)
    assert np.allclose(size["union"] + size["intersection"], first + second, atol=1e-4)


def test_rings_of_overlay():
    box = lambda x, y, w: [closed([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])]
    union = lambda a, b: pairs(o._made([column([a]), column([b])], OPERATIONS["union"][0]).to_pylist()[0])
    less = lambda a, b: pairs(o._made([column([a]), column([b])], OPERATIONS["difference"][0]).to_pylist()[0])
    assert union([box(0, 0, 2)], [box(2, 0, 2)]) == [[closed([(0, 2), (0, 0), (4, 0), (4, 2)])]]  # an edge in common goes
    assert len(union([box(0, 0, 2)], [box(2, 2, 2)])) == 2  # a corner in common doesn't join
    ringed = less([box(0, 0, 9)], [box(3, 3, 3)])
    assert [len(p) for p in ringed] == [2] and area(ringed) == 72
    touching = less([box(0, 0, 9)], [[closed([(0, 0), (5, 3), (3, 5)])]])  # the hole touches the shell in a corner
    assert [len(p) for p in touching] == [2] and area(touching) == pytest.approx(81 - 8)
    nested = union(less([box(0, 0, 30)], [box(5, 5, 20)]), less([box(10, 10, 10)], [box(12, 12, 2)]))  # a ring in the hole of a ring
    assert [len(p) for p in nested] == [2, 2] and area(nested) == 900 - 400 + 100 - 4
    assert less([box(0, 0, 2)], [box(-1, -1, 9)]) == []


def test_repair():
    bow = [[closed([(0, 0), (4, 4), (4, 0), (0, 2)])]]
    backwards = [[closed([(0, 0), (0, 3), (3, 3), (3, 0)]), closed([(1, 1), (2, 1), (2, 2), (1, 2)])]]
    overlapping = [[closed([(0, 0), (4, 0), (4, 4), (0, 4)])], [closed([(2, 2), (6, 2), (6, 6), (2, 6)])]]
    spike = [[closed([(0, 0), (4, 0), (4, 4), (9, 4), (4, 4), (0, 4)])]]
    found = [pairs(x) for x in o._made([column([bow, backwards, overlapping, spike, []])], lambda w: w[:, 0] > 0).to_pylist()]
    assert [len(x) for x in found] == [1, 1, 1, 1, 0]
    assert [area(x) for x in found] == pytest.approx([16 / 3, 8, 28, 16, 0], abs=1e-5)


def test_columns(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), (2, None, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (3, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", None)], "id int, a string, b string")
    a, b = (g.parse_wkt(F.col(k)) for k in "ab")
    size = lambda x: F.round(F.aggregate(g.polygon_parts(x), F.lit(0.0), lambda s, p: s + g.area(p)), 4)
    rows = df.select("id", size(o.difference(a, b)), size(o.intersection(a, b)), size(o.union(a, b)), size(o.repaired(a))).collect()
    assert [tuple(r) for r in rows] == [(1, 12, 4, 28, 16), (2, None, None, 0.5, None), (3, 4, None, 4, 4)]


def test_sizes_and_middles(spark):
    """The two ways to measure shapes agree."""
    cases = [a for pair in shapes(60, 21) for a in pair]
    df = spark.createDataFrame([*enumerate(column(cases).to_pylist()), (999, None), (998, [])], "id int, geometry array<array<array<struct<x:double,y:double>>>>")
    made = df.select("id", "geometry", o.size_and_middle(F.col("geometry")).alias("m")).select("id", "m", g.area(F.col("geometry")).alias("size"), g.centroid(F.col("geometry")).alias("c"))
    for r in made.collect():
        if r.id == 999:
            assert r.m is None
        elif r.id == 998:
            assert tuple(r.m) == (0.0, None, None)
        else:
            assert tuple(r.m) == pytest.approx((r.size, r.c.x, r.c.y), rel=1e-9) and r.size == pytest.approx(area(cases[r.id]), rel=1e-9)
