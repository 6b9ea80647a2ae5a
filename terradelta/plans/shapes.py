"""Queries over footprints of real shapes: boxes, L shapes and frames with a hole, from the same boxes as the other queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import overlay
from ..operators import spatial
from ..sources.tables import dealt, merging, written
from . import bindings as b

c = F.col
CELL = 80.0


def shape_wkt() -> Column:
    """id % 3: 0 the box, 1 without its upper right quarter, 2 with a hole in the middle (its middle third, by whole numbers)."""
    x0, y0, x1, y1 = c("x0"), c("y0"), c("x1"), c("y1")
    mx, my = F.floor((x0 + x1) / 2), F.floor((y0 + y1) / 2)
    point = lambda x, y: F.concat_ws(" ", x, y)
    ring = lambda *p: F.concat(F.lit("("), F.concat_ws(", ", *p), F.lit(")"))
    box = ring(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    ell = ring(point(x0, y0), point(x1, y0), point(x1, my), point(mx, my), point(mx, y1), point(x0, y1), point(x0, y0))
    hole = ring(point(x0 + 3, y0 + 3), point(x1 - 3, y0 + 3), point(x1 - 3, y1 - 3), point(x0 + 3, y1 - 3), point(x0 + 3, y0 + 3))
    kind = F.pmod(c("id"), F.lit(3))
    body = F.when(kind == 0, box).when(kind == 1, ell).otherwise(F.concat(box, F.lit(", "), hole))
    return F.concat(F.lit("POLYGON ("), body, F.lit(")"))


def _shaped(df: DataFrame) -> DataFrame:
    """id, bounds, geometry, area and centroid of each object, written once: searches and joins read them again and again."""
    known = dealt(df).select("id", *spatial.BOUNDS, g.parse_wkt(shape_wkt()).alias("geometry"))
    sized = known.select("id", *spatial.BOUNDS, "geometry", overlay.size_and_middle(c("geometry")).alias("m"))
    return written(sized.select("id", *spatial.BOUNDS, "geometry", c("m.size").alias("size"), F.struct("m.x", "m.y").alias("middle")))


def _iou(common: Column, a: str, b_: str) -> Column:
    return F.round(F.coalesce(F.try_divide(common, c(f"{a}size") + c(f"{b_}size") - common), F.lit(0.0)), 9)


def _scored(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose bounds overlap, with the area that they have in common, worked out once for each."""
    pairs = spatial.overlapping(left, right, CELL)
    return pairs.select("l_id", "r_id", "l_size", "r_size", overlay.common_area(c("l_geometry"), c("r_geometry")).alias("common")).select("l_id", "r_id", _iou(c("common"), "l_", "r_").alias("score"))


def polygon_best_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each old shape's new shape of the highest IoU over 0."""
    old = _shaped(b.old_footprints(spark, sf))
    best = spatial.matches(_scored(old, _shaped(b.new_footprints(spark, sf))))
    return old.select("id").join(merging(best), "id", "left")


def polygon_external_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each updated shape the reference shape of the highest IoU with it or with the original, then the nearest centroid to the original's."""
    named = lambda df, p: df.select("id", *(c(k).alias(p + k) for k in (*spatial.BOUNDS, "geometry", "size")))
    old, new = _shaped(b.old_footprints(spark, sf)), _shaped(b.new_footprints(spark, sf))
    left = named(_shaped(b.final_footprints(spark, sf)), "f").join(merging(named(old, "o").join(merging(old.select("id", "middle")), "id")), "id")
    wide = left.select("*", *(F.least("f" + k, "o" + k).alias(k) for k in ("x0", "y0")), *(F.greatest("f" + k, "o" + k).alias(k) for k in ("x1", "y1")))
    d2 = lambda m: F.round((c(m)["x"] - c("r_middle")["x"]) ** 2 + (c(m)["y"] - c("r_middle")["y"]) ** 2, 6)
    pairs = spatial.overlapping(wide, new, CELL)
    common = pairs.select("l_id", "r_id", "l_fsize", "l_osize", "r_size", d2("l_middle").alias("tie"), overlay.common_area(c("l_fgeometry"), c("r_geometry")).alias("f"), overlay.common_area(c("l_ogeometry"), c("r_geometry")).alias("o"))
    scored = common.select("l_id", "r_id", "tie", _iou(c("f"), "l_f", "r_").alias("iou_final"), _iou(c("o"), "l_o", "r_").alias("iou_orig")).withColumn("score", F.greatest("iou_final", "iou_orig"))
    carried = {"iou_final": 0.0, "iou_orig": 0.0}
    found = spatial.matched_or_nearest(old.select("id", *spatial.BOUNDS, "middle"), scored, new.select("id", *spatial.BOUNDS, "middle"), d2("l_middle"), CELL, carried)
    return found.select("id", "match_id", *carried)


def polygon_best_any(spark: SparkSession, sf: str) -> DataFrame:
    """For each updated shape the reference shape of the highest IoU, or the one at the least distance where none overlaps; and the original's best IoU."""
    final, new = _shaped(b.final_footprints(spark, sf)), _shaped(b.new_footprints(spark, sf))
    d2 = g.let(F.round(g.distance(c("l_geometry"), c("r_geometry"), F.lit(0.0)), 6), lambda d: d * d)  # of objects without an overlap
    found = spatial.matched_or_nearest(final, _scored(final, new).withColumn("tie", F.lit(0.0)), new, d2, CELL)
    orig = spatial.matches(_scored(_shaped(b.old_footprints(spark, sf)), new)).select("id", c("best_score").alias("orig_iou"))
    return found.join(merging(orig), "id", "left").select("id", "match_id", c("best_score").alias("max_iou"), F.coalesce("orig_iou", F.lit(0.0)).alias("orig_max_iou"))


def polygon_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Area, perimeter, centroid, holes, hull and concavity, moved to map coordinates."""
    far = b.old_footprints(spark, sf).withColumns({k: c(k) + (383_000 if k[0] == "x" else 5_820_000) for k in spatial.BOUNDS})
    m = far.select("id", *spatial.BOUNDS, g.parse_wkt(shape_wkt()).alias("geometry")).select("id", g.area(c("geometry")).alias("size"), g.centroid(c("geometry")).alias("middle"), g.perimeter(c("geometry")).alias("length"), g.holes(c("geometry")).alias("holes"), g.hull_area(c("geometry")).alias("hull"))
    return m.select("id", F.round("size", 6).alias("size"), F.round("length", 6).alias("length"), F.round("middle.x", 6).alias("cx"), F.round("middle.y", 6).alias("cy"), "holes", F.round("hull", 6).alias("hull"), F.round(g.concavity(c("size"), c("hull")), 9).alias("concavity"))


def polygon_parts_iterator(spark: SparkSession, sf: str) -> DataFrame:
    """Two shapes as one geometry of several parts, and each part again."""
    whole = F.concat(g.parse_wkt(shape_wkt()), g.box(c("x0") + 1000, c("y0"), c("x0") + 1001, c("y0") + 2))
    parts = b.old_footprints(spark, sf).select("id", F.posexplode(g.polygon_parts(whole)).alias("part", "geometry"))
    return parts.select("id", "part", F.round(g.area(c("geometry")), 6).alias("size"))


QUERIES = (polygon_best_overlap, polygon_external_match, polygon_best_any, polygon_measures, polygon_parts_iterator)


def boxes(name: str, of: str) -> str:
    m = "SELECT *, (x0 + x1) // 2 AS mx, (y0 + y1) // 2 AS my, id % 3 AS k FROM " + of
    return f"""{name} AS (SELECT id, x0 AS a, y0 AS b, x1 AS c, y1 AS d FROM {of} WHERE id % 3 = 0
      UNION ALL SELECT id, x0, y0, x1, my FROM ({m}) WHERE k = 1 UNION ALL SELECT id, x0, my, mx, y1 FROM ({m}) WHERE k = 1
      UNION ALL SELECT id, x0, y0, x1, y0 + 3 FROM {of} WHERE id % 3 = 2 UNION ALL SELECT id, x0, y1 - 3, x1, y1 FROM {of} WHERE id % 3 = 2
      UNION ALL SELECT id, x0, y0 + 3, x0 + 3, y1 - 3 FROM {of} WHERE id % 3 = 2 UNION ALL SELECT id, x1 - 3, y0 + 3, x1, y1 - 3 FROM {of} WHERE id % 3 = 2),
    {name}_m AS (SELECT id, sum((c - a) * (d - b))::DOUBLE AS size, sum((c - a) * (d - b) * (a + c)) / 2 / sum((c - a) * (d - b))::DOUBLE AS cx, sum((c - a) * (d - b) * (b + d)) / 2 / sum((c - a) * (d - b))::DOUBLE AS cy FROM {name} GROUP BY id)"""


def oracle_sql(old: str, new: str, final: str) -> dict[str, str]:
    """Every shape as boxes that don't overlap, so that areas, centroids and distances are sums and least values over boxes."""

    def ious(name: str, left: str, right: str) -> str:
        return f"""{name} AS (SELECT x.l, x.r, round(x.common / (p.size + q.size - x.common), 9) AS iou FROM (
          SELECT p.id AS l, q.id AS r, sum((least(p.c, q.c) - greatest(p.a, q.a)) * (least(p.d, q.d) - greatest(p.b, q.b)))::DOUBLE AS common FROM {left} p JOIN {right} q ON p.a < q.c AND q.a < p.c AND p.b < q.d AND q.b < p.d GROUP BY ALL) x
          JOIN {left}_m p ON p.id = x.l JOIN {right}_m q ON q.id = x.r)"""

    o, n, f = boxes("ob", "old"), boxes("nb", "new"), boxes("fb", "final")
    every = f"{old}, {new}, {final}, {o}, {n}, {f}, {ious('fi', 'fb', 'nb')}, {ious('oi', 'ob', 'nb')}"
    first = "row_number() OVER (PARTITION BY l ORDER BY iou DESC, r) = 1"
    d2 = "greatest(0, q.a - p.c, p.a - q.c) * greatest(0, q.a - p.c, p.a - q.c) + greatest(0, q.b - p.d, p.b - q.d) * greatest(0, q.b - p.d, p.b - q.d)"
    mid = "(x0 + x1) // 2"
    return {
        "polygon_best_overlap": f"WITH {old}, {new}, {o}, {n}, {ious('oi', 'ob', 'nb')}, z AS (SELECT * FROM oi WHERE iou > 0 QUALIFY {first}) SELECT id, r AS match_id, iou AS best_score FROM old LEFT JOIN z ON l = id",
        "polygon_external_match": f"""WITH {every}, s AS (SELECT l, r, max(iou) AS iou FROM (SELECT * FROM fi UNION ALL SELECT * FROM oi) GROUP BY ALL HAVING max(iou) > 0),
          t AS (SELECT l, r FROM s JOIN ob_m p ON p.id = l JOIN nb_m q ON q.id = r QUALIFY row_number() OVER (PARTITION BY l ORDER BY iou DESC, round((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy), 6), r) = 1),
          u AS (SELECT p.id AS l, q.id AS r FROM ob_m p JOIN nb_m q ON p.id NOT IN (SELECT l FROM t) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy), 6), q.id) = 1),
          v AS (SELECT * FROM t UNION ALL SELECT * FROM u)
          SELECT v.l AS id, v.r AS match_id, coalesce(fi.iou, 0) AS iou_final, coalesce(oi.iou, 0) AS iou_orig FROM v LEFT JOIN fi USING (l, r) LEFT JOIN oi USING (l, r)""",
        "polygon_best_any": f"""WITH {every}, t AS (SELECT l, r, iou FROM fi WHERE iou > 0 QUALIFY {first}), k AS (SELECT l, max(iou) AS iou FROM oi WHERE iou > 0 GROUP BY l),
          u AS (SELECT p.id AS l, q.id AS r, 0.0::DOUBLE AS iou FROM fb p JOIN nb q ON p.id NOT IN (SELECT l FROM t) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {d2}, q.id) = 1)
          SELECT v.l AS id, v.r AS match_id, v.iou AS max_iou, coalesce(k.iou, 0) AS orig_max_iou FROM (SELECT * FROM t UNION ALL SELECT * FROM u) v LEFT JOIN k USING (l)""",
        "polygon_measures": f"""WITH {old}, {o}, w AS (SELECT id, x1 - x0 AS w, y1 - y0 AS h, x1 - {mid} AS nw, y1 - {mid.replace('x', 'y')} AS nh FROM old)
          SELECT w.id, m.size, (2 * (w + h) + CASE WHEN w.id % 3 = 2 THEN 2 * (w - 6 + h - 6) ELSE 0 END)::DOUBLE AS length, round(m.cx + 383000, 6) AS cx, round(m.cy + 5820000, 6) AS cy, CASE WHEN w.id % 3 = 2 THEN 1 ELSE 0 END AS holes,
            round(w * h - CASE WHEN w.id % 3 = 1 THEN nw * nh / 2 ELSE 0 END, 6)::DOUBLE AS hull, round(m.size / (w * h - CASE WHEN w.id % 3 = 1 THEN nw * nh / 2 ELSE 0 END), 9) AS concavity FROM w JOIN ob_m m USING (id)""",
        "polygon_parts_iterator": f"WITH {old}, {o} SELECT id, 0 AS part, size FROM ob_m UNION ALL SELECT id, 1, 2.0::DOUBLE FROM old",
    }
