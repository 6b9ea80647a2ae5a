"""Run-length masks against pixel by pixel versions."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terradelta.functions import geometry as g
from terradelta.functions import masks as m

from .test_overlay import area, column, inside, local, pairs, shapes, turn

W, H = 40, 30


def images(n, seed):
    """Random masks: noise, blocks, and some that touch the border."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = r.random((H, W)) < (0.3, 0.6, 0.9, 0.0)[i % 4]
        for _ in range(i % 3):
            x, y = r.integers(0, W - 3), r.integers(0, H - 3)
            a[y : y + r.integers(1, 12), x : x + r.integers(1, 12)] = i % 2 == 0
        out.append(a)
    return [*out, np.ones((H, W), bool)]


def runs(image):
    out = []
    for y, line in enumerate(image):
        x = 0
        while x < len(line):
            if line[x]:
                a = x
                while x + 1 < len(line) and line[x + 1]:
                    x += 1
                out.append({"y": y, "x0": a, "x1": x})
            x += 1
    return out


def runs_column(all_):
    return pa.array([runs(i) for i in all_], m.KIND)


def parts(image):
    """Pixels of each part that hangs together over edges, largest first, then the first in reading order."""
    left, out = {(y, x) for y, x in zip(*np.nonzero(image), strict=True)}, []
    for p in sorted(left):
        if p in left:
            part, todo = set(), [p]
            left.discard(p)
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            out.append(part)
    return sorted(out, key=lambda s: (-len(s), min(s)))


def test_sets():
    a, b = images(24, 1), images(24, 2)
    for of, truth in ((lambda n: (n > 0).all(axis=1), np.logical_and), (lambda n: (n > 0).any(axis=1), np.logical_or), (lambda n: (n[:, 0] > 0) & (n[:, 1] == 0), lambda p, q: p & ~q)):
        got = m.to_arrow(m.swept([m.runs_of(runs_column(a)), m.runs_of(runs_column(b))], of), len(a)).to_pylist()
        assert got == [runs(truth(p, q)) for p, q in zip(a, b, strict=True)]


def test_dilation():
    a = images(12, 3)
    got = m.to_arrow(m.dilated(m.runs_of(runs_column(a)), 3, np.full(len(a), W), np.full(len(a), H)), len(a)).to_pylist()
    for image, found in zip(a, got, strict=True):
        wide = np.pad(image, 3)
        want = np.zeros_like(image)
        for i in range(7):
            for j in range(7):
                want |= wide[i : i + H, j : j + W]
        assert found == runs(want)


def test_parts_and_outlines():
    a = images(30, 4)
    r = m.runs_of(runs_column(a))
    best = m.to_arrow(m.largest(r), len(a)).to_pylist()
    shapes_ = [pairs(x) for x in m.outline(r, len(a)).to_pylist()]
    for image, part, polygons in zip(a, best, shapes_, strict=True):
        every = parts(image)
        want = np.zeros_like(image)
        for y, x in every[0] if every else ():
            want[y, x] = True
        assert part == runs(want)
        assert [area([p]) for p in polygons] == [len(p) for p in every]
        again = np.array([[inside(polygons, x + 0.5, y + 0.5) for x in range(W)] for y in range(H)])
        assert (again == image).all()
        for p in polygons:
            assert turn(p[0]) > 0 and all(turn(h) < 0 for h in p[1:])
            assert all(len(set(ring)) == len(ring) - 1 for ring in p)


def plain_fill(geometry):
    """Ring after ring: pixels inside or on an edge; edges drawn along their longer side."""
    out = np.zeros((H, W), bool)
    for polygon in geometry:
        for k, ring in enumerate(polygon):
            pts = [(int(np.rint(x)), int(np.rint(y))) for x, y in ring]
            hit = np.array([[inside([[pts]], x, y) for x in range(W)] for y in range(H)])
            for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
                n = max(abs(bx - ax), abs(by - ay), 1)
                for t in range(n + 1):
                    x, y = math.floor(ax + t * (bx - ax) / n + 0.5), math.floor(ay + t * (by - ay) / n + 0.5)
                    if 0 <= x < W and 0 <= y < H:
                        hit[y, x] = True
            out = (out | hit) if k == 0 else (out & ~hit)
    return out


def test_fill():
    r = random.Random(5)
    cases = [[[[(x * 2 + dx, y * 2 + dy) for x, y in ring] for ring in polygon] for polygon in local(a)] for a, _ in shapes(60, 6) for dx, dy in [(r.uniform(-9, 20), r.uniform(-9, 15))]]
    n = len(cases)
    got = m.to_arrow(m.filled(column([*cases, None, []]), pa.array([W] * (n + 2)), pa.array([H] * (n + 2))), n + 2).to_pylist()
    assert got == [*(runs(plain_fill(c)) for c in cases), [], []]


def plain_deep(image, k, radius):
    zero = [(y, x) for y, x in zip(*np.nonzero(~image), strict=True)]
    d = {(y, x): min(((y - v) ** 2 + (x - u) ** 2 for v, u in zero), default=-1) for y, x in zip(*np.nonzero(image), strict=True)}
    work, out = {p: (v if v >= 0 else math.inf) for p, v in d.items()}, []
    while work and len(out) < k:
        p = min(work, key=lambda q: (-work[q], q))
        out.append({"x": p[1], "y": p[0], "d2": d[p]})
        work = {q: v for q, v in work.items() if (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 > radius**2}
    return out


def test_deepest():
    a = images(18, 7)
    got = m.deep_points(m.runs_of(runs_column(a)), len(a), np.arange(len(a)) % 4, 4, np.full(len(a), W), np.full(len(a), H)).to_pylist()
    assert got == [plain_deep(image, i % 4, 4) for i, image in enumerate(a)]


def test_grey():
    r = np.random.default_rng(8)
    a, b = images(9, 9), images(9, 10)
    grey = r.integers(0, 256, (len(a), H, W)).astype(np.uint8)
    found = m.grey_measures(pa.array([x.tobytes() for x in grey]), np.full(len(a), W), m.runs_of(runs_column(a)), m.runs_of(runs_column(b)), 12.0)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        v, around = grey[i][p].astype(float), grey[i][q].astype(float)
        want = (v.mean(), v.std(), (v < v.mean() - 12).mean(), around.mean(), around.mean() - v.mean()) if len(v) and len(around) else None
        if want:
            assert np.allclose([found[k][i] for k in found], want)
        elif not len(v):
            assert np.isnan(found["mean"][i]) and np.isnan(found["drop"][i])


def test_columns(spark):
    wide, high = F.lit(64), F.lit(48)
    df = spark.createDataFrame([(1, "POLYGON ((2 3, 11 3, 11 8, 2 8, 2 3), (5 5, 8 5, 8 6, 5 6, 5 5))"), (2, None), (3, "POLYGON ((100 100, 101 100, 101 101, 100 100))")], "id int, wkt string")
    masks = df.select("id", m.fill(g.parse_wkt(F.col("wkt")), wide, high).alias("mask"))
    c = F.col("mask")
    rows = masks.select("id", m.pixels(c), m.bounds(c), m.centroid(c), m.pixels(m.ring(c, 8, wide, high)), m.iou(c, m.dilate(c, 1, wide, high)), F.size(m.polygons(c)), m.deepest(c, F.lit(1), 5, wide, high)).collect()
    assert rows[0][1] == 60 - 8 and tuple(rows[0][2]) == (2, 3, 11, 8) and rows[0][3].x == 6.5
    assert rows[0][4] == 20 * 17 - 60 + 8 and rows[0][5] == 52 / 96 and rows[0][6] == 1  # 17 lines: the image ends above; growth by 1 closes the hole
    assert rows[1][1:] == (None, None, None, None, 0.0, None, None)  # a missing mask has nothing in common with any
    assert rows[2][1] == 0 and rows[2][2] is None and rows[2][6] == 0 and rows[2][7] == []
