"""Queries over overlays, masks and prompt points of the shapes in shapes.py."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks as m
from ..functions import overlay, prompts
from ..operators import dissolve, spatial
from ..sources import tables as t
from . import bindings as b
from .shapes import CELL, shape_wkt

c = F.col
SIDE = 64


def shapes(df: DataFrame) -> DataFrame:
    return df.select("id", *spatial.BOUNDS, g.parse_wkt(shape_wkt()).alias("geometry"))


def _whole(x: Column) -> Column:
    return F.round(x, 4)


def _area(geometry: Column) -> Column:
    return F.aggregate(g.polygon_parts(geometry), F.lit(0.0), lambda s, p: s + g.area(p))


# overlays ----------------------------------------------------------------------------------------------------


def polygon_difference(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each old shape's hull outside it, of 5 and more square metres, the largest first, at map coordinates."""
    far = b.old_footprints(spark, sf).withColumns({k: c(k) + (383_000 if k[0] == "x" else 5_820_000) for k in spatial.BOUNDS})
    gaps = shapes(far).select("id", overlay.hull_gaps(c("geometry")).alias("gaps"))
    pieces = gaps.select("id", F.posexplode(g.polygon_parts(prompts.of_size(c("gaps"), 5.0))).alias("piece", "p"))
    found = pieces.select("id", "piece", g.area(c("p")).alias("size"), g.bounds(c("p")).alias("b"), F.size(c("p")[0][0]).alias("n"))
    return found.select("id", "piece", _whole(c("size")).alias("size"), *(F.round(c("b." + k), 3).alias(k) for k in spatial.BOUNDS), (c("n") - 1).alias("corners"))


def polygon_change(spark: SparkSession, sf: str) -> DataFrame:
    """What an update took from each shape, what it added, and both together."""
    both = shapes(b.old_footprints(spark, sf)).select("id", c("geometry").alias("old")).join(shapes(b.final_footprints(spark, sf)).select("id", c("geometry").alias("new")), "id")
    made = both.select("id", overlay.difference(c("old"), c("new")).alias("lost"), overlay.difference(c("new"), c("old")).alias("won"), overlay.union(c("old"), c("new")).alias("all"), overlay.intersection(c("old"), c("new")).alias("kept"))
    return made.select("id", *(_whole(_area(c(k))).alias(k) for k in ("lost", "won", "all", "kept")))


def polygon_union_largest(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of five neighbours: the union of their old and new shapes, its parts, and the largest one."""
    old, new = b.old_footprints(spark, sf), b.new_footprints(spark, sf).where(c("id") < 1_000_000_000)
    every = shapes(old).unionByName(shapes(new)).select(F.floor(c("id") / 5).alias("block"), "geometry")
    one = dissolve.dissolve(every, ["block"], "geometry", CELL)
    return one.select("block", F.size("geometry").alias("parts"), _whole(_area(c("geometry"))).alias("size"), _whole(_area(dissolve.largest("geometry"))).alias("largest"))


def _broken_wkt() -> Column:
    """id % 3: 0 the box, clockwise; 1 a ring that crosses itself, its first lobe twice as high; 2 two boxes that overlap in a half."""
    x0, y0, x1, y1 = c("x0"), c("y0"), c("x1"), c("y1")
    point = lambda x, y: F.concat_ws(" ", x, y)
    ring = lambda *p: F.concat(F.lit("("), F.concat_ws(", ", *p), F.lit(")"))
    back = ring(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))
    low = y0 + 6
    bow = ring(point(x0, y0), point(x1, low), point(x1, y0), point(x0, y0 + 12), point(x0, y0))
    up = lambda d: ring(point(x0 + d, y0), point(x1 + d, y0), point(x1 + d, y1), point(x0 + d, y1), point(x0 + d, y0))
    kind = F.pmod(c("id"), F.lit(3))
    one = lambda r: F.concat(F.lit("POLYGON ("), r, F.lit(")"))
    return F.when(kind == 0, one(back)).when(kind == 1, one(bow)).otherwise(F.concat(F.lit("MULTIPOLYGON (("), up(0), F.lit("), ("), up(4), F.lit("))")))


def polygon_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Valid geometries of rings that run backwards, cross themselves or overlap."""
    made = b.old_footprints(spark, sf).select("id", overlay.repaired(g.parse_wkt(_broken_wkt())).alias("g"))
    return made.select("id", F.size("g").alias("parts"), F.round(_area(c("g")), 3).alias("size"), *(F.round(g.bounds(c("g"))[k], 3).alias(k) for k in spatial.BOUNDS))


# predicates and prompts --------------------------------------------------------------------------------------


def objects_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 6 by 5 and the shapes that have a point in common with them, edges included: not those that hold them in a hole or beside them."""
    s = c("s_suppkey")
    windows = b.boxes(t.parquet(spark, sf, "supplier"), s, s * 37 % 1960, s * 53 % 700, F.lit(6), F.lit(5))
    objects = shapes(b.old_footprints(spark, sf))
    near = spatial.overlapping(windows, objects.drop("geometry"), CELL, touching=True).select(c("l_id").alias("window"), c("r_id").alias("id"), *(c("l_" + k).alias("w" + k) for k in spatial.BOUNDS))
    met = near.join(objects.select("id", "geometry"), "id").where(g.meets_box(c("geometry"), c("wx0"), c("wy0"), c("wx1"), c("wy1")))
    return met.select("window", "id")


def interior_points(spark: SparkSession, sf: str) -> DataFrame:
    """A point in each shape, whether its centroid is covered, and how far both are from the edge."""
    found = shapes(b.old_footprints(spark, sf)).select("id", "geometry", g.interior_point(c("geometry")).alias("p"), g.centroid(c("geometry")).alias("m"))
    deep = lambda k: F.round(g.boundary_distance2(c("geometry"), c(k)["x"], c(k)["y"]), 6)
    return found.select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), deep("p").alias("depth2"), g.contains(c("geometry"), c("p.x"), c("p.y")).alias("inside"), g.covers(c("geometry"), c("m.x"), c("m.y")).alias("centroid_inside"))


def _listed(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", F.round(p["x"] * 1000).cast("long"), F.round(p["y"] * 1000).cast("long"))), ",")


def pixel_shapes(df: DataFrame, old: DataFrame, at: int = 8) -> DataFrame:
    """Shapes of df in the pixels of a chip whose corner lies `at` before that of the old footprint of the same id, a metre a pixel."""
    corner = old.select("id", (c("x0") - at).alias("cx"), (c("y0") - at).alias("cy"))
    moved = t.dealt(df).join(t.merging(t.dealt(corner)), "id").select("id", *((c(k) - c("c" + k[0])).alias(k) for k in spatial.BOUNDS))
    return shapes(moved)


def prompt_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Three points deep inside each shape of a chip, and what a complex one gets besides, as whole thousandths."""
    old = b.old_footprints(spark, sf)
    grid = pixel_shapes(old, old).select("id", "geometry", prompts.grid(c("geometry")).alias("grid"))
    deep = grid.select("id", (F.size(c("geometry")[0]) > 1).alias("complex"), prompts.candidates(c("geometry"), c("grid")).alias("deep"))
    found = deep.select("id", prompts.spread(c("deep"), F.lit(3)).alias("p"), prompts.extra(c("deep"), 1, 2, c("complex")).alias("e"))
    return found.select("id", _listed(c("p")).alias("points"), _listed(c("e")).alias("extra"))


def prompt_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Four places around each shape of a chip, a point in each large hole, and one in each large part of the hull outside it."""
    old = b.old_footprints(spark, sf)
    shape = pixel_shapes(old, old).select("id", "geometry", overlay.hull_gaps(c("geometry")).alias("gaps"))
    found = shape.select("id", prompts.around(c("geometry"), F.lit(4), 2.5, SIDE, SIDE).alias("a"), prompts.in_holes(c("geometry"), 2, 30.0).alias("h"), prompts.in_gaps(prompts.of_size(c("gaps"), 20.0), 2).alias("g"))
    return found.select("id", _listed(c("a")).alias("ring"), _listed(c("h")).alias("holes"), _listed(c("g")).alias("gaps"))


# masks -------------------------------------------------------------------------------------------------------


def _masks(df: DataFrame, old: DataFrame) -> DataFrame:
    return pixel_shapes(df, old).select("id", m.fill(c("geometry"), F.lit(SIDE), F.lit(SIDE)).alias("mask"))


def _bar() -> Column:
    """Three columns of pixels through the middle of the bounds, over all lines of the chip."""
    x = F.floor((c("x0") + c("x1")) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.struct(y.cast("int").alias("y"), (x - 1).cast("int").alias("x0"), (x + 1).cast("int").alias("x1")))


def mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of each shape's mask."""
    old = b.old_footprints(spark, sf)
    return _masks(old, old).select("id", F.inline("mask"))


def _two(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of the old shapes and of the new ones, where there is one; these may leave the chip."""
    old = b.old_footprints(spark, sf)
    new = b.new_footprints(spark, sf).where(c("id") < 1_000_000_000)
    return _masks(old, old).withColumnRenamed("mask", "a").join(_masks(new, old).withColumnRenamed("mask", "b"), "id")


def mask_pair_iou(spark: SparkSession, sf: str) -> DataFrame:
    """IoU of old and new masks, what the new one lacks and what it has besides, its bounds and centroid."""
    two = _two(spark, sf).select("id", "a", "b", m.difference(c("a"), c("b")).alias("missing"), m.difference(c("b"), c("a")).alias("spill"), m.union(c("a"), c("b")).alias("all"))
    made = two.select("id", m.iou(c("a"), c("b")).alias("iou"), *(m.pixels(c(k)).alias(k) for k in ("missing", "spill", "all")), m.bounds(c("b")).alias("box"), m.centroid(c("b")).alias("mid"))
    return made.select("id", F.round("iou", 9).alias("iou"), "missing", "spill", "all", "box.*", F.round("mid.x", 6).alias("cx"), F.round("mid.y", 6).alias("cy"))


def chip_image() -> Column:
    """A grey chip, a byte a pixel: (x * x + 3 * y + id) % 256. There are 256 different lines, by (3 * y + id) % 256."""
    lines = ["".join(f"{(x * x + k) % 256:02x}" for x in range(SIDE)) for k in range(256)]
    known = F.from_json(F.lit(json.dumps(lines)), "array<string>")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.get(known, ((3 * y + c("id")) % 256).cast("int"))), ""))


def mask_ring_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Grey values under each mask against its ring of 8 pixels: mean, deviation, share 12 under the mean, and the drop."""
    old = b.old_footprints(spark, sf)
    made = _masks(old, old).select("id", "mask", m.ring(c("mask"), 8, F.lit(SIDE), F.lit(SIDE)).alias("ring"), chip_image().alias("image"))
    found = made.select("id", m.pixels(c("ring")).alias("ring_pixels"), m.grey(c("image"), F.lit(SIDE), c("mask"), c("ring")).alias("v"))
    return found.select("id", "ring_pixels", *(F.round(c("v")[k], 6).alias(k) for k in ("mean", "deviation", "dark", "ring_mean", "drop")))


def mask_largest_part(spark: SparkSession, sf: str) -> DataFrame:
    """Each mask less a bar through its middle: the larger of the parts that are left."""
    old = b.old_footprints(spark, sf)
    made = pixel_shapes(old, old).select("id", m.difference(m.fill(c("geometry"), F.lit(SIDE), F.lit(SIDE)), _bar()).alias("mask"))
    part = made.select("id", m.pixels(c("mask")).alias("pixels"), m.largest_part(c("mask")).alias("p"))
    return part.select("id", "pixels", m.pixels(c("p")).alias("largest"), m.bounds(c("p"))["x0"].alias("x0"), m.bounds(c("p"))["x1"].alias("x1"))


def mask_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """The same masks as polygons along the edges of pixels, largest first."""
    old = b.old_footprints(spark, sf)
    made = pixel_shapes(old, old).select("id", m.polygons(m.difference(m.fill(c("geometry"), F.lit(SIDE), F.lit(SIDE)), F.when(c("id") % 2 == 0, _bar()).otherwise(F.slice(_bar(), 1, 0)))).alias("g"))
    each = made.select("id", F.posexplode(g.polygon_parts(c("g"))).alias("part", "p"))
    return each.select("id", "part", F.round(g.area(c("p"))).cast("long").alias("pixels"), F.size(c("p")[0]).alias("rings"), F.aggregate(c("p")[0], F.lit(0), lambda s, r: s + F.size(r) - 1).alias("corners"), *(g.bounds(c("p"))[k].cast("long").alias(k) for k in spatial.BOUNDS))


def correction_points(spark: SparkSession, sf: str) -> DataFrame:
    """The two deepest pixels of what the new mask lacks, and of what it has besides, at least 5 pixels apart."""
    two = _two(spark, sf)
    deep = lambda x: m.deepest(x, F.lit(2), 5, F.lit(SIDE), F.lit(SIDE))
    made = two.select("id", deep(m.difference(c("a"), c("b"))).alias("missing"), deep(m.difference(c("b"), c("a"))).alias("spill"))
    text = lambda k: F.array_join(F.transform(k, lambda p: F.concat_ws(" ", p["x"], p["y"], p["d2"])), ",")
    return made.select("id", text("missing").alias("missing"), text("spill").alias("spill"))


def as_of_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's latest order state at a day, from snapshots partitioned by day."""
    o = t.parquet(spark, sf, "orders")
    states = o.select(c("o_custkey").alias("id"), c("o_orderstatus").alias("state"), c("o_orderkey").alias("key"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("snapshot_date"))
    path = t.write_snapshots(states)
    return t.as_of(t.snapshots(spark, path), "id", "key", "1998-06-15").select("id", "state", "key", c("snapshot_date").cast("string").alias("snapshot_date"))


QUERIES = (
    polygon_difference, polygon_change, polygon_union_largest, polygon_repair, objects_in_window, interior_points, prompt_positives, prompt_negatives, mask_runs, mask_pair_iou, mask_ring_measures,
    mask_largest_part, mask_polygons, correction_points, as_of_states,
)


def oracle_sql(old: str, new: str, final: str, boxes) -> dict[str, str]:
    """Shapes as boxes that don't overlap, masks as sets of pixels. boxes(name, of): CTEs of the boxes and of their sums (shapes.py)."""
    ob, fb, nb = boxes("ob", "old"), boxes("fb", "final"), boxes("nb", "near")
    near = f"{new}, near AS (SELECT * FROM new WHERE id < 1000000000)"
    dims = "s AS (SELECT *, id % 3 AS k, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) // 2 AS mx, (y0 + y1) // 2 AS my FROM old)"
    common = "common AS (SELECT p.id, sum(greatest(0, least(p.c, q.c) - greatest(p.a, q.a)) * greatest(0, least(p.d, q.d) - greatest(p.b, q.b)))::DOUBLE AS common FROM ob p JOIN fb q USING (id) GROUP BY 1)"

    # chips: the old footprint's corner at (8, 8)
    def chip(name: str, of: str) -> str:
        return f"{name} AS (SELECT f.id, f.x0 - o.x0 + 8 AS x0, f.y0 - o.y0 + 8 AS y0, f.x1 - o.x0 + 8 AS x1, f.y1 - o.y0 + 8 AS y1, f.id % 3 AS k, (f.x0 + f.x1 - 2 * o.x0 + 16) // 2 AS mx, (f.y0 + f.y1 - 2 * o.y0 + 16) // 2 AS my FROM {of} f JOIN old o USING (id))"

    inside = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (k = 0 OR k = 1 AND (x <= mx OR y <= my) OR k = 2 AND NOT (x BETWEEN x0 + 3 AND x1 - 3 AND y BETWEEN y0 + 3 AND y1 - 3))"
    grid = "grid AS (SELECT x, y FROM range(64) a(x), range(64) b(y))"
    pixels = lambda name, of: f"{name} AS MATERIALIZED (SELECT id, k, mx, x, y FROM {of} JOIN grid ON {inside})"
    one = f"{old}, {chip('p', 'old')}, {grid}, {pixels('a', 'p')}"
    both = f"{old}, {near}, {chip('p', 'old')}, {chip('q', 'near')}, {grid}, {pixels('a', 'p')}, {pixels('b', 'q')}"

    def deepest(name: str, of: str) -> str:
        """The two deepest pixels of a set: squared distances to the nearest pixel of the chip outside it."""
        return f"""{name}_d AS MATERIALIZED (SELECT s.id, s.x, s.y, min(o.dx * o.dx + o.dy * o.dy) AS d2 FROM {of} s JOIN off o ON s.x + o.dx BETWEEN 0 AND 63 AND s.y + o.dy BETWEEN 0 AND 63
            ANTI JOIN {of} t ON t.id = s.id AND t.x = s.x + o.dx AND t.y = s.y + o.dy GROUP BY 1, 2, 3),
          {name}_1 AS (SELECT * FROM {name}_d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2 DESC, y, x) = 1),
          {name}_2 AS (SELECT d.* FROM {name}_d d JOIN {name}_1 e USING (id) WHERE (d.x - e.x) * (d.x - e.x) + (d.y - e.y) * (d.y - e.y) > 25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d.d2 DESC, d.y, d.x) = 1)"""

    shown = lambda k: f"coalesce({k}_1.x || ' ' || {k}_1.y || ' ' || {k}_1.d2, '') || coalesce(',' || {k}_2.x || ' ' || {k}_2.y || ' ' || {k}_2.d2, '')"

    def greedy(points: str, n: int) -> str:
        """CTEs g1 ... gn: of points (id, i, x, y) the first, then always the farthest from those before, ties by i."""
        out = [f"g1 AS (SELECT * FROM {points} QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1)"]
        for j in range(2, n + 1):
            gap = lambda m: f"(p.x - g{m}.x) * (p.x - g{m}.x) + (p.y - g{m}.y) * (p.y - g{m}.y)"
            joins = " ".join(f"JOIN g{m} USING (id)" for m in range(1, j))
            free = " AND ".join(f"p.i <> g{m}.i" for m in range(1, j))
            out.append(f"g{j} AS (SELECT p.id, p.i, p.x, p.y FROM {points} p {joins} WHERE {free} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY least({', '.join(map(gap, range(1, j)))}) DESC, p.i) = 1)")
        return ", ".join(out)

    written = lambda g: f"round({g}.x * 1000)::BIGINT || ' ' || round({g}.y * 1000)::BIGINT"
    sides = """e AS (SELECT id, x0 AS a, y0 AS b, x1 AS c, y0 AS d FROM p UNION ALL SELECT id, x0, y0, x0, y1 FROM p
      UNION ALL SELECT id, x1, y0, x1, CASE WHEN k = 1 THEN my ELSE y1 END FROM p UNION ALL SELECT id, x0, y1, CASE WHEN k = 1 THEN mx ELSE x1 END, y1 FROM p
      UNION ALL SELECT id, mx, my, x1, my FROM p WHERE k = 1 UNION ALL SELECT id, mx, my, mx, y1 FROM p WHERE k = 1
      UNION ALL SELECT id, x0 + 3, y0 + 3, x1 - 3, y0 + 3 FROM p WHERE k = 2 UNION ALL SELECT id, x0 + 3, y1 - 3, x1 - 3, y1 - 3 FROM p WHERE k = 2
      UNION ALL SELECT id, x0 + 3, y0 + 3, x0 + 3, y1 - 3 FROM p WHERE k = 2 UNION ALL SELECT id, x1 - 3, y0 + 3, x1 - 3, y1 - 3 FROM p WHERE k = 2)"""
    d = lambda x: f"{x}::DOUBLE"
    return {
        "polygon_difference": f"""WITH {old}, {dims} SELECT id, 0 AS piece, CASE k WHEN 1 THEN (x1 - mx) * (y1 - my) / {d(2)} ELSE {d('((w - 6) * (h - 6))')} END AS size,
            (383000 + CASE k WHEN 1 THEN mx ELSE x0 + 3 END)::DOUBLE AS x0, (5820000 + CASE k WHEN 1 THEN my ELSE y0 + 3 END)::DOUBLE AS y0,
            (383000 + CASE k WHEN 1 THEN x1 ELSE x1 - 3 END)::DOUBLE AS x1, (5820000 + CASE k WHEN 1 THEN y1 ELSE y1 - 3 END)::DOUBLE AS y1, CASE k WHEN 1 THEN 3 ELSE 4 END AS corners FROM s WHERE k > 0""",
        "polygon_change": f"WITH {old}, {final}, {ob}, {fb}, {common} SELECT id, o.size - common AS lost, f.size - common AS won, o.size + f.size - common AS \"all\", common AS kept FROM common JOIN ob_m o USING (id) JOIN fb_m f USING (id)",
        "polygon_union_largest": f"""WITH RECURSIVE {old}, {near}, {ob}, {nb}, v AS MATERIALIZED (SELECT row_number() OVER () AS n, id // 5 AS block, a, b, c, d FROM (SELECT * FROM ob UNION ALL SELECT * FROM nb)),
          e AS MATERIALIZED (SELECT p.n AS x, q.n AS y FROM v p JOIN v q ON p.block = q.block AND least(p.c, q.c) >= greatest(p.a, q.a) AND least(p.d, q.d) >= greatest(p.b, q.b) AND (least(p.c, q.c) > greatest(p.a, q.a) OR least(p.d, q.d) > greatest(p.b, q.b))),
          reach(x, y) AS (SELECT n, n FROM v UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), l AS (SELECT x AS n, min(y) AS label FROM reach GROUP BY 1),
          u AS (SELECT DISTINCT block, label, x, unnest(range(b, d)) AS y FROM (SELECT block, label, unnest(range(a, c)) AS x, b, d FROM v JOIN l USING (n))),
          t AS (SELECT block, label, count(*) AS size FROM u GROUP BY 1, 2) SELECT block, count(*) AS parts, sum(size)::DOUBLE AS size, max(size)::DOUBLE AS largest FROM t GROUP BY 1""",
        "polygon_repair": f"""WITH {old}, {dims} SELECT id, 1 AS parts, (CASE k WHEN 0 THEN w * h WHEN 1 THEN 4 * w ELSE (w + 4) * h END)::DOUBLE AS size, x0::DOUBLE AS x0, y0::DOUBLE AS y0,
            CASE k WHEN 0 THEN x1 WHEN 1 THEN round(x0 + 2 * w / {d(3)}, 3) ELSE x1 + 4 END::DOUBLE AS x1, CASE k WHEN 1 THEN y0 + 12 ELSE y1 END::DOUBLE AS y1 FROM s""",
        "objects_in_window": f"WITH {old}, {ob}, w AS (SELECT s_suppkey AS win, s_suppkey * 37 % 1960 AS x, s_suppkey * 53 % 700 AS y FROM supplier) SELECT DISTINCT win AS \"window\", id FROM w JOIN ob ON a <= x + 6 AND x <= c AND b <= y + 5 AND y <= d",
        "interior_points": f"""WITH {old}, {dims}, {ob} SELECT id, CASE k WHEN 0 THEN (x0 + x1) / {d(2)} WHEN 1 THEN (x0 + mx) / {d(2)} ELSE x0 + 1.5::DOUBLE END AS x, CASE k WHEN 1 THEN (my + y1) / {d(2)} ELSE (y0 + y1) / {d(2)} END AS y,
            CASE k WHEN 0 THEN least(w, h) * least(w, h) / {d(4)} WHEN 1 THEN least(mx - x0, y1 - my) * least(mx - x0, y1 - my) / {d(4)} ELSE 2.25::DOUBLE END AS depth2, true AS inside, k = 0 OR k = 1 AND (cx <= mx OR cy <= my) AS centroid_inside FROM s JOIN ob_m USING (id)""",
        "prompt_positives": f"""WITH {old}, {chip('p', 'old')}, {sides}, {boxes('pb', 'p')},
          c AS (SELECT id, 0 AS i, CASE k WHEN 0 THEN (x0 + x1) / {d(2)} WHEN 1 THEN (x0 + mx) / {d(2)} ELSE x0 + 1.5::DOUBLE END AS x, CASE k WHEN 1 THEN (my + y1) / {d(2)} ELSE (y0 + y1) / {d(2)} END AS y FROM p
            UNION ALL SELECT id, 1, cx, cy FROM pb_m JOIN p USING (id) WHERE k = 0 OR k = 1 AND (cx <= mx OR cy <= my)
            UNION ALL SELECT id, i, x, y FROM (SELECT p.*, 2 + r * 9 + l AS i, x0 + l * (x1 - x0) / {d(8)} AS x, y0 + r * (y1 - y0) / {d(8)} AS y FROM p, range(9) t(l), range(9) u(r))
              WHERE k = 0 OR k = 1 AND (x <= mx OR y <= my) OR k = 2 AND NOT (x > x0 + 3 AND x < x1 - 3 AND y > y0 + 3 AND y < y1 - 3)),
          m AS (SELECT c.id, i, x, y, round(min(greatest(0, e.a - x, x - e.c) * greatest(0, e.a - x, x - e.c) + greatest(0, e.b - y, y - e.d) * greatest(0, e.b - y, y - e.d)), 9) AS d2 FROM c JOIN e USING (id) GROUP BY ALL),
          o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY d2 DESC, i) AS i, x, y FROM m QUALIFY row_number() OVER (PARTITION BY id, round_even(x, 1), round_even(y, 1) ORDER BY d2 DESC, m.i) = 1),
          {greedy('o', 3)} SELECT id, {written('g1')} || ',' || {written('g2')} || ',' || {written('g3')} AS points, CASE WHEN id % 3 = 2 THEN {written('g2')} || ',' || {written('g3')} ELSE '' END AS extra FROM g1 JOIN g2 USING (id) JOIN g3 USING (id)""",
        "prompt_negatives": f"""WITH {old}, {chip('p', 'old')}, r AS (SELECT *, greatest({d(2.5)}, {d(0.18)} * greatest(x1 - x0, y1 - y0)) AS m FROM p),
          f AS (SELECT *, greatest(0, x0 - m) AS ex0, greatest(0, y0 - m) AS ey0, least(63, x1 + m) AS ex1, least(63, y1 + m) AS ey1 FROM r),
          t AS (SELECT id, [ex0, (ex0 + x0) / 2, (x0 + x1) / {d(2)}, (x1 + ex1) / 2, ex1] AS xs, [ey0, (ey0 + y0) / 2, (y0 + y1) / {d(2)}, (y1 + ey1) / 2, ey1] AS ys FROM f),
          o AS (SELECT id, i, xs[1 + [0, 2, 4, 4, 4, 2, 0, 0, 1, 3, 4, 4, 3, 1, 0, 0][i]] AS x, ys[1 + [0, 0, 0, 2, 4, 4, 4, 2, 0, 0, 1, 3, 4, 4, 3, 1][i]] AS y FROM t, range(1, 17) q(i)), {greedy('o', 4)}
          SELECT id, {written('g1')} || ',' || {written('g2')} || ',' || {written('g3')} || ',' || {written('g4')} AS ring,
            CASE WHEN k = 2 AND (x1 - x0 - 6) * (y1 - y0 - 6) >= 30 THEN (x0 + x1) * 500 || ' ' || (y0 + y1) * 500 ELSE '' END AS holes,
            CASE WHEN k = 1 AND (x1 - mx) * (y1 - my) >= 40 THEN (3 * mx + x1) * 250 || ' ' || (my + y1) * 500 WHEN k = 2 AND (x1 - x0 - 6) * (y1 - y0 - 6) >= 20 THEN (x0 + x1) * 500 || ' ' || (y0 + y1) * 500 ELSE '' END AS gaps
          FROM p JOIN g1 USING (id) JOIN g2 USING (id) JOIN g3 USING (id) JOIN g4 USING (id)""",
        "mask_runs": f"WITH {one} SELECT id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT id, x, y, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS isle FROM a) GROUP BY id, y, isle",
        "mask_pair_iou": f"""WITH {both}, n AS (SELECT coalesce(a.id, b.id) AS id, count(*) AS every, count(*) FILTER (b.id IS NULL) AS missing, count(*) FILTER (a.id IS NULL) AS spill FROM a FULL JOIN b ON a.id = b.id AND a.x = b.x AND a.y = b.y GROUP BY 1),
          m AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM b GROUP BY 1)
          SELECT id, round((every - missing - spill)::DOUBLE / every, 9) AS iou, missing, spill, every AS \"all\", x0, y0, x1, y1, cx, cy FROM n JOIN m USING (id)""",
        "mask_ring_measures": f"""WITH {one}, w AS (SELECT id, x0, y0, x1, CASE WHEN k = 1 THEN my ELSE y1 END AS y1 FROM p WHERE k < 2 UNION ALL SELECT id, x0, y0, mx, y1 FROM p WHERE k = 1 UNION ALL SELECT id, x0, y0, x1, y0 + 2 FROM p WHERE k = 2
            UNION ALL SELECT id, x0, y1 - 2, x1, y1 FROM p WHERE k = 2 UNION ALL SELECT id, x0, y0, x0 + 2, y1 FROM p WHERE k = 2 UNION ALL SELECT id, x1 - 2, y0, x1, y1 FROM p WHERE k = 2),
          g AS (SELECT DISTINCT w.id, x, y FROM w JOIN grid ON x BETWEEN x0 - 8 AND x1 + 8 AND y BETWEEN y0 - 8 AND y1 + 8), ring AS (SELECT g.* FROM g ANTI JOIN a USING (id, x, y)),
          v AS (SELECT id, (x * x + 3 * y + id) % 256 AS v FROM a), m AS (SELECT id, avg(v) AS mean, stddev_pop(v) AS deviation FROM v GROUP BY 1), k AS (SELECT v.id, avg((v < mean - 12)::INT) AS dark FROM v JOIN m USING (id) GROUP BY 1),
          r AS (SELECT id, count(*) AS ring_pixels, avg((x * x + 3 * y + id) % 256) AS ring_mean FROM ring GROUP BY 1)
          SELECT id, ring_pixels, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(dark, 6) AS dark, round(ring_mean, 6) AS ring_mean, round(ring_mean - mean, 6) AS "drop" FROM m JOIN k USING (id) JOIN r USING (id)""",
        "mask_largest_part": f"""WITH {one}, t AS (SELECT id, x > mx AS east, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM a WHERE abs(x - mx) > 1 GROUP BY 1, 2)
          SELECT id, sum(n) OVER (PARTITION BY id)::BIGINT AS pixels, n AS largest, x0, x1 FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, east) = 1""",
        "mask_polygons": f"""WITH {one}, t AS (SELECT id, k, id % 2 = 0 AS cut, id % 2 = 0 AND x > mx AS east, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM a WHERE id % 2 = 1 OR abs(x - mx) > 1 GROUP BY 1, 2, 3, 4)
          SELECT id, row_number() OVER (PARTITION BY id ORDER BY pixels DESC, x0) - 1 AS part, pixels, CASE WHEN k = 2 AND NOT cut THEN 2 ELSE 1 END AS rings, CASE WHEN k = 2 THEN 8 WHEN k = 1 AND NOT cut THEN 6 ELSE 4 END AS corners, x0, y0, x1, y1 FROM t""",
        "correction_points": f"""WITH {both}, off AS (SELECT dx, dy FROM range(-13, 14) t(dx), range(-13, 14) u(dy)), miss AS MATERIALIZED (SELECT a.id, a.x, a.y FROM a SEMI JOIN q USING (id) ANTI JOIN b USING (id, x, y)), spill AS MATERIALIZED (SELECT b.id, b.x, b.y FROM b ANTI JOIN a USING (id, x, y)),
          {deepest('m', 'miss')}, {deepest('s', 'spill')} SELECT q.id, {shown('m')} AS missing, {shown('s')} AS spill FROM q LEFT JOIN m_1 ON m_1.id = q.id LEFT JOIN m_2 ON m_2.id = q.id LEFT JOIN s_1 ON s_1.id = q.id LEFT JOIN s_2 ON s_2.id = q.id""",
        "as_of_states": "SELECT o_custkey AS id, arg_max(o_orderstatus, (date_trunc('month', o_orderdate), o_orderkey)) AS state, arg_max(o_orderkey, (date_trunc('month', o_orderdate), o_orderkey)) AS key, strftime(max(date_trunc('month', o_orderdate)), '%Y-%m-%d') AS snapshot_date FROM orders WHERE date_trunc('month', o_orderdate) <= DATE '1998-06-15' GROUP BY 1",
    }
