"""Prompt points, predicates and dissolve on slanted, concave and holed shapes against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry as g
from terradelta.plans import overlays
from terradelta.functions import overlay, prompts
from terradelta.plans import overlays
from terradelta.operators import dissolve

from .test_overlay import area, column, inside, local, off_edge, shapes, turn

W = H = 40


@pytest.fixture(scope="module")
def cases():
    """Valid shapes near the origin."""
    return [local(a) for a, _ in shapes(80, 11)]


@pytest.fixture(scope="module")
def df(spark, cases):
    rows = list(enumerate(column(cases).to_pylist()))
    return spark.createDataFrame(rows, "id int, geometry array<array<array<struct<x:double,y:double>>>>").repartition(3)


def plain_interior(geometry):
    """The middle of the widest span half way between the corners next to the middle height."""
    best = (-1.0, None)
    for polygon in geometry:
        ys = [y for ring in polygon for _, y in ring]
        mid = (min(ys) + max(ys)) / 2
        y = (max(v for v in ys if v <= mid) + min(v for v in ys if v > mid)) / 2
        xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for ring in polygon for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False) if (ay > y) != (by > y))
        for a, b in zip(xs[::2], xs[1::2], strict=True):
            if b - a > best[0] + 1e-12:
                best = (b - a, ((a + b) / 2, y))
    return best[1]


def plain_centroid(geometry):
    total = mx = my = 0.0
    for polygon in geometry:
        for k, ring in enumerate(polygon):
            sign = (1 if k == 0 else -1) * math.copysign(1, turn(ring))
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                cross = (ax * by - bx * ay) * sign
                total, mx, my = total + cross, mx + (ax + bx) * cross, my + (ay + by) * cross
    return mx / 3 / total, my / 3 / total


def covers(geometry, x, y):
    return inside(geometry, x, y) or off_edge(geometry, x, y) < 1e-12


def spread(points, k):
    if len(points) <= k:
        return points
    taken, left = points[:1], points[1:]
    while len(taken) < k:
        i = max(range(len(left)), key=lambda j: (min((left[j][0] - q[0]) ** 2 + (left[j][1] - q[1]) ** 2 for q in taken), -j))
        taken.append(left.pop(i))
    return taken


def unique(points):
    seen, out = set(), []
    for x, y in points:
        if (key := (round(x, 1), round(y, 1))) not in seen:
            seen.add(key)
            out.append((x, y))
    return out


def plain_positives(geometry, n):
    points = [p for ring in geometry for r in ring for p in r]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    every = [plain_interior(geometry)]
    if covers(geometry, *plain_centroid(geometry)):
        every.append(plain_centroid(geometry))
    every += [(x, y) for j in range(9) for i in range(9) for x, y in [(x0 + i * (x1 - x0) / 8, y0 + j * (y1 - y0) / 8)] if covers(geometry, x, y)]
    every.sort(key=lambda p: -round(off_edge(geometry, *p) ** 2, 9))
    return spread(unique(every), n)


def near(a, b):
    return len(a) == len(b) and all(math.dist(p, q) < 1e-6 for p, q in zip(a, b, strict=True))


def test_points_of_shapes(df, cases):
    c = F.col("geometry")
    for r in df.select("id", g.interior_point(c).alias("p"), g.centroid(c).alias("m"), g.covers(c, g.centroid(c)["x"], g.centroid(c)["y"]).alias("in")).collect():
        shape = cases[r.id]
        assert math.dist(r.p, plain_interior(shape)) < 1e-9 and inside(shape, *r.p)
        assert math.dist(r.m, plain_centroid(shape)) < 1e-9 and r["in"] == covers(shape, *r.m)


def test_positives(df, cases):
    deep = df.select("id", "geometry", prompts.grid(F.col("geometry")).alias("grid")).select("id", prompts.candidates(F.col("geometry"), F.col("grid")).alias("deep"))
    same = 0
    for r in deep.select("id", prompts.spread(F.col("deep"), F.lit(4)).alias("p"), prompts.spread(F.col("deep"), F.lit(1)).alias("one"), prompts.extra(F.col("deep"), 1, 2, F.col("id") % 2 == 0).alias("e")).collect():
        want = plain_positives(cases[r.id], 4)
        same += near([tuple(p) for p in r.p], want)
        assert len(r.p) == len(want) and all(covers(cases[r.id], *p) or off_edge(cases[r.id], *p) < 1e-9 for p in r.p)
        assert len(r.one) == 1 and len(r.e) == (2 if r.id % 2 == 0 and len(plain_positives(cases[r.id], 3)) == 3 else 0)
    assert same >= len(cases) - 3  # a grid point on a slanted edge may be in or out


def test_around_holes_and_gaps(df, cases):
    c = F.col("geometry")
    made = df.select("id", "geometry", overlay.hull_gaps(c).alias("gaps")).select("id", "gaps", prompts.around(c, F.lit(5), 3.0, W, H).alias("a"), prompts.in_holes(c, 2, 1.0).alias("h"), prompts.in_gaps(prompts.of_size(F.col("gaps"), 0.5), 3).alias("g"))
    for r in made.collect():
        shape = cases[r.id]
        points = [p for polygon in shape for ring in polygon for p in ring]
        (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
        m = max(3.0, 0.18 * max(x1 - x0, y1 - y0))
        a, b, u, v = max(0.0, x0 - m), max(0.0, y0 - m), min(W - 1.0, x1 + m), min(H - 1.0, y1 + m)
        xs, ys = (a, (a + x0) / 2, (x0 + x1) / 2, (x1 + u) / 2, u), (b, (b + y0) / 2, (y0 + y1) / 2, (y1 + v) / 2, v)
        places = [(xs[i], ys[j]) for i, j in ((0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2), (1, 0), (3, 0), (4, 1), (4, 3), (3, 4), (1, 4), (0, 3), (0, 1))]
        assert near([tuple(p) for p in r.a], spread(unique([p for p in places if not inside(shape, *p) and off_edge(shape, *p) >= 2]), 5))
        assert len(r.h) == sum(len(p) - 1 for p in shape)
        for p in r.h:
            assert not inside(shape, *p)
        hull = _hull(points)
        gaps = [[[(q["x"], q["y"]) for q in ring] for ring in polygon] for polygon in r.gaps]
        assert area(gaps) == pytest.approx(turn(hull) - area(shape), abs=1e-4)
        assert len(r.g) == min(3, sum(area([x]) >= 0.5 for x in gaps))
        for p in r.g:
            assert inside([[hull]], *p) and not inside(shape, *p)


def _hull(points):
    chain = []
    for pts in (sorted(set(points)), sorted(set(points), reverse=True)):
        out = []
        for p in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        chain += out[:-1]
    return [*chain, chain[0]]


def test_meets_box(spark, df, cases):
    r = random.Random(12)
    windows = [(x, y, x + r.choice([0.1, 1.0, 30.0]), y + r.choice([0.1, 1.0, 30.0])) for _ in range(40) for x, y in [(r.uniform(-5, 20), r.uniform(-5, 20))]]
    box = lambda w: [[[(w[0], w[1]), (w[2], w[1]), (w[2], w[3]), (w[0], w[3]), (w[0], w[1])]]]
    found = df.select("id", *(g.meets_box(F.col("geometry"), *map(F.lit, w)).alias(f"w{i}") for i, w in enumerate(windows))).collect()

    def meets(shape, w):
        if any(w[0] <= x <= w[2] and w[1] <= y <= w[3] for p in shape for ring in p for x, y in ring) or inside(shape, w[0], w[1]):
            return True
        cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        sides = list(zip(box(w)[0][0], box(w)[0][0][1:], strict=False))
        return any(cross(a, b, s) * cross(a, b, t) < 0 and cross(s, t, a) * cross(s, t, b) < 0 for p in shape for ring in p for a, b in zip(ring, ring[1:], strict=False) for s, t in sides)

    for row in found:
        assert [row[f"w{i}"] for i in range(len(windows))] == [meets(cases[row.id], w) for w in windows]
    edge = spark.range(1).select(g.meets_box(g.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), F.lit(2), F.lit(2), F.lit(3), F.lit(3)), g.meets_box(g.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), F.lit(2.1), F.lit(2), F.lit(3), F.lit(3))).first()
    assert tuple(edge) == (True, False)


def test_dissolve(spark, df, cases):
    got = {r.k: r.geometry for r in dissolve.dissolve(df.withColumn("k", F.col("id") % 4).unionByName(spark.createDataFrame([(9, None, 9)], "id int, geometry array<array<array<struct<x:double,y:double>>>>, k int")), ["k"], "geometry", 7.0).collect()}
    r = random.Random(3)
    assert set(got) == {0, 1, 2, 3}
    for k, union in got.items():
        every = [c for i, c in enumerate(cases) if i % 4 == k]
        found = [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in union]
        sizes = [area([p]) for p in found]
        assert sizes == sorted(sizes, reverse=True)
        for _ in range(200):
            x, y = r.uniform(-8, 25), r.uniform(-8, 25)
            if all(off_edge(c, x, y) > 1e-4 for c in every):
                assert inside(found, x, y) == any(inside(c, x, y) for c in every)


def test_places_around_are_measured_in_batches(spark):
    """Sides were gathered again for each of the 16 places, and few tasks had all rows."""
    assert "zip_with" not in str(prompts.around(F.col("geometry"), F.lit(4), 2.5, W, H))
    old = spark.range(20).select("id", *((F.col("id") * 40 + k).alias(n) for n, k in (("x0", 0), ("y0", 0), ("x1", 12), ("y1", 10)))).coalesce(1)
    assert overlays.pixel_shapes(old, old).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
