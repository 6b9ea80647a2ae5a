import math

import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry as g
from terradelta.operators import spatial

HOLE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
MULTI = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 6, 5 6, 5 5)))"


def table(spark, *wkt):
    return spark.createDataFrame([(i, w) for i, w in enumerate(wkt)], "id long, wkt string").withColumn("geometry", g.parse_wkt(F.col("wkt")))


def test_measures(spark):
    rows = table(spark, HOLE, MULTI).select(g.area(F.col("geometry")), g.perimeter(F.col("geometry")), g.holes(F.col("geometry")), g.centroid(F.col("geometry"))).collect()
    assert rows[0][0] == 96 and rows[0][1] == 48 and rows[0][2] == 1
    assert rows[0][3].x == pytest.approx((500 - 4 * 3) / 96)
    assert rows[1][0] == 3 and rows[1][2] == 0


def test_text_that_is_no_polygon_is_null(spark):
    assert [r[0] for r in table(spark, "POINT (1 2)", "", "POLYGON ((a b, c d))", None).select("geometry").collect()] == [None] * 4


def test_wkt_round_trip(spark):
    t = table(spark, HOLE, MULTI).withColumn("again", g.parse_wkt(g.to_wkt(F.col("geometry"))))
    assert t.where("geometry = again").count() == 2


def test_common_area(spark):
    t = table(spark, HOLE, MULTI, "POLYGON ((3 3, 12 3, 12 12, 3 12, 3 3))", "POLYGON ((10 0, 12 0, 12 10, 10 10, 10 0))", "POLYGON ((0 0, 4 0, 2 4, 0 0))")
    pairs = t.alias("a").join(t.alias("b"), F.col("a.id") < F.col("b.id")).select("a.id", F.col("b.id").alias("other"), g.common_area(g.edges(F.col("a.geometry")), g.edges(F.col("b.geometry"))).alias("x")).collect()
    got = {(r.id, r.other): r.x for r in pairs}
    assert got[0, 2] == pytest.approx(48)  # 7 x 7 less the corner of the hole
    assert got[0, 3] == 0 and got[0, 1] == pytest.approx(3)
    assert got[2, 4] == pytest.approx(0, abs=1e-12) and got[0, 4] == pytest.approx(7)


def test_common_area_of_crossing_edges_and_directions(spark):
    """Triangles that cross, in either direction of the ring, at map coordinates."""
    at = lambda pts: "POLYGON ((" + ", ".join(f"{383_000 + x} {5_820_000 + y}" for x, y in pts) + "))"
    up, down = [(0, 0), (8, 0), (4, 8), (0, 0)], [(0, 6), (4, -2), (8, 6), (0, 6)]
    t = table(spark, at(up), at(up[::-1]), at(down), at(down[::-1]))
    e = t.select("id", g.edges(F.col("geometry")).alias("e"))
    got = {(r.i, r.j): r.x for r in e.alias("a").join(e.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), g.common_area(F.col("a.e"), F.col("b.e")).alias("x")).collect()}
    assert got[0, 1] == pytest.approx(32) and got[2, 3] == pytest.approx(32)
    hexagon = got[0, 2]  # by pixels
    k = 400
    inside = sum(1 for i in range(k) for j in range(k) if (x := 8 * (i + 0.5) / k, y := 8 * (j + 0.5) / k) and y < 2 * min(x, 8 - x) and y < 6 and y > 2 * abs(x - 4) - 2)
    assert hexagon == pytest.approx(inside * 64 / k**2, rel=0.01) and all(got[k] == pytest.approx(hexagon) for k in ((0, 3), (1, 2), (1, 3)))


def test_measures_at_map_coordinates(spark):
    """Centroid and area of quadrilaterals of about 10 m far from the origin, against exact fractions."""
    import random
    from fractions import Fraction

    r, shapes = random.Random(4), []
    for _ in range(100):
        x, y = 383_000 + r.randrange(1000), 5_820_000 + r.randrange(1000)
        shapes.append([(x + r.randrange(3), y + r.randrange(3)), (x + 10 + r.randrange(3), y), (x + 9, y + 9 + r.randrange(4)), (x, y + 8)])
    t = table(spark, *("POLYGON ((" + ", ".join(f"{a} {b}" for a, b in [*s, s[0]]) + "))" for s in shapes))
    for row in t.select("id", g.area(F.col("geometry")).alias("a"), g.centroid(F.col("geometry")).alias("m"), g.edges(F.col("geometry")).alias("e")).collect():
        s = shapes[row.id]
        cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(s, [*s[1:], s[0]], strict=True)]
        size = Fraction(sum(cross), 2)
        cx = Fraction(sum((a[0] + b[0]) * c for a, b, c in zip(s, [*s[1:], s[0]], cross, strict=True)), 1) / (6 * size)
        assert row.a == pytest.approx(float(abs(size)), abs=1e-9) and row.m.x == pytest.approx(float(cx), abs=1e-8, rel=0)


def test_hull_and_distance(spark):
    t = table(spark, "POLYGON ((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))", "POLYGON ((7 8, 9 8, 9 9, 7 9, 7 8))")
    assert t.where("id = 0").select(g.hull_area(F.col("geometry"))).first()[0] == pytest.approx(16)
    d = t.alias("a").join(t.alias("b"), F.col("a.id") < F.col("b.id")).select(g.distance(F.col("a.geometry"), F.col("b.geometry"), F.lit(0.0))).first()[0]
    assert d == pytest.approx(5)


def test_reprojection_at_the_meridian(spark):
    r = spark.range(1).select(g.utm_from_degrees(F.lit(15.0), F.lit(52.5)).alias("p"), g.utm_from_degrees(F.lit(13.4), F.lit(52.5)).alias("q")).first()
    assert r.p.x == pytest.approx(500000) and r.q.x < 500000
    assert math.hypot(r.p.x - r.q.x, 0) == pytest.approx(108_600, rel=0.01)


def boxes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, x0 long, y0 long, x1 long, y1 long")


def test_best_overlap_ties_and_misses(spark):
    left = boxes(spark, (1, 0, 0, 10, 10), (2, 100, 100, 110, 110), (3, 10, 0, 20, 10))
    right = boxes(spark, (8, 0, 0, 10, 5), (7, 0, 5, 10, 10), (9, 20, 0, 30, 10))
    got = {r.id: (r.match_id, r.best_score) for r in spatial.best_overlap(left, right, g.box_iou("l_", "r_"), 4.0).collect()}
    assert got == {1: (7, 0.5), 2: (None, None), 3: (None, None)}  # equal scores: the least id; touching isn't overlapping


def test_each_pair_once_over_many_cells(spark):
    left, right = boxes(spark, (1, -7, -7, 50, 50)), boxes(spark, (5, -3, -3, 40, 60))
    assert spatial.overlapping(left, right, 3.0).count() == 1


def test_nearest_is_exact(spark):
    import random

    r = random.Random(3)
    make = lambda i, far: (i, x := r.randrange(far), y := r.randrange(far), x + 1 + r.randrange(9), y + 1 + r.randrange(9))
    left, right = [make(i, 3000) for i in range(40)], [make(100 + i, 500) for i in range(25)]
    centre = lambda a, b: (a[1] + a[3] - b[1] - b[3]) ** 2 + (a[2] + a[4] - b[2] - b[4]) ** 2
    want = {a[0]: min(right, key=lambda b: (centre(a, b), b[0]))[0] for a in left}
    got = spatial.nearest(boxes(spark, *left), boxes(spark, *right), g.centre_distance2("l_", "r_") / 4, 16.0)
    assert {x.id: x.match_id for x in got.collect()} == want


def test_nearest_by_bounds_with_a_giant(spark):
    import random

    r = random.Random(8)
    make = lambda i, far, side: (i, x := r.randrange(far), y := r.randrange(far), x + 1 + r.randrange(side), y + 1 + r.randrange(side))
    left = [make(i, 4000, 9) for i in range(50)]
    right = [make(100 + i, 900, 9) for i in range(30)] + [(500, 2000, 2000, 2900, 2300)]
    gap = lambda a, b: max(0, b[1] - a[3], a[1] - b[3]) ** 2 + max(0, b[2] - a[4], a[2] - b[4]) ** 2
    want = {a[0]: min(right, key=lambda b: (gap(a, b), b[0]))[0] for a in left}
    got = spatial.nearest(boxes(spark, *left), boxes(spark, *right), g.box_distance2("l_", "r_"), 16.0)
    assert {x.id: x.match_id for x in got.collect()} == want


def test_overlapping_of_very_different_sizes(spark):
    import random

    r = random.Random(9)
    make = lambda i: (i, x := r.randrange(-500, 500), y := r.randrange(-500, 500), x + 1 + int(r.paretovariate(0.8)) % 900, y + 1 + int(r.paretovariate(0.8)) % 900)
    left, right = [make(i) for i in range(80)], [make(i) for i in range(80)]
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    got = sorted((x.l_id, x.r_id) for x in spatial.overlapping(boxes(spark, *left), boxes(spark, *right), 8.0).select("l_id", "r_id").collect())
    assert got == want


def test_nearest_without_anything_to_find(spark):
    assert spatial.nearest(boxes(spark, (1, 0, 0, 1, 1)), boxes(spark, (2, 0, 0, 1, 1)).limit(0), g.centre_distance2("l_", "r_"), 8.0).count() == 0


def test_nearest_finds_giants_and_its_way_around_clashing_columns(spark):
    left = boxes(spark, (1, 0, 0, 10, 10), (2, 5000, 5000, 5001, 5001)).withColumns({k: F.lit("x") for k in ("level", "cx", "part", "own", "match_id", "best_score", "_best", "bound")})
    right = boxes(spark, (7, 12, 0, 2012, 10), (8, -12, 0, -10, 2)).withColumns({k: F.lit("y") for k in ("level", "cy", "i", "t", "fit", "any")})
    got = {r.id: (r.match_id, r.distance2) for r in spatial.nearest(left, right, g.box_distance2("l_", "r_"), 16.0).collect()}
    assert got == {1: (7, 4.0), 2: (7, 2988.0**2 + 4990.0**2)}  # the long one is nearer than the small one at 10
    pairs = spatial.overlapping(left, right, 8.0, touching=True)
    assert set(pairs.columns) == {"l_" + k for k in left.columns} | {"r_" + k for k in right.columns} and pairs.count() == 0


def test_touching_bounds(spark):
    left, right = boxes(spark, (1, 0, 0, 8, 8), (2, -80, -80, 0, 0)), boxes(spark, (5, 8, 8, 16, 16), (6, 0, -300, 700, 0), (7, 9, 0, 10, 8))
    found = lambda t: sorted((r.l_id, r.r_id) for r in spatial.overlapping(left, right, 8.0, touching=t).collect())
    assert found(True) == [(1, 5), (1, 6), (2, 6)] and found(False) == []


def test_nearest_against_all_pairs_of_very_different_sizes(spark):
    import random

    r = random.Random(19)
    make = lambda i: (i, x := r.randrange(-9000, 9000), y := r.randrange(-9000, 9000), x + 1 + int(r.paretovariate(0.6)) % 3000, y + 1 + int(r.paretovariate(0.6)) % 3000)
    left, right = [make(i) for i in range(60)], [make(100 + i) for i in range(50)]
    gap = lambda a, b: max(0, b[1] - a[3], a[1] - b[3]) ** 2 + max(0, b[2] - a[4], a[2] - b[4]) ** 2
    centre = lambda a, b: (a[1] + a[3] - b[1] - b[3]) ** 2 + (a[2] + a[4] - b[2] - b[4]) ** 2
    for column, plain in ((g.box_distance2("l_", "r_"), gap), (g.centre_distance2("l_", "r_") / 4, centre)):
        want = {a[0]: min(right, key=lambda b: (plain(a, b), b[0]))[0] for a in left}  # noqa: B023
        assert {x.id: x.match_id for x in spatial.nearest(boxes(spark, *left), boxes(spark, *right), column, 16.0).collect()} == want


def test_area_works_out_its_geometry_once(spark):
    """area(parse_wkt(...)) parsed the text again for each point."""
    assert str(g.area(F.upper("a text"))).count("a text") == 1
    texts = ["POLYGON ((0 0, 4 0, 4 3, 0 0))", " multipolygon  z (((0 0 7,  1 0 7, 1 \n 1 7, 0 0 7)), ((5 5 1, 7 5 1, 7 6 1, 5 5 1)))", "POLYGON ((0 0, 1 x, 1 1, 0 0))", "POINT (1 1)", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(g.area(g.parse_wkt(F.col("t")))).collect()] == [6.0, 1.5, None, None, None]
