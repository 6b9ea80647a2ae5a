"""Queries over single functions of geometries, samples, and tables written and read again."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import images, overlay
from ..functions import masks as m
from ..operators import evaluation as ev
from ..operators import ranking, rules, sampling, spatial
from ..sources import tables as t
from . import bindings as b
from .overlays import SIDE, chip_image, pixel_shapes, shapes

c = F.col


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each object's geometry under three experiments; the second lacks some objects, the third others."""
    named = lambda df, k: shapes(df).select("id", c("geometry").alias(k))
    one = named(b.old_footprints(spark, sf), "one")
    two = named(b.final_footprints(spark, sf).where(c("id") % 11 > 0), "two")
    return one.join(two, "id", "left").join(named(b.new_footprints(spark, sf), "three"), "id", "left")


def geometry_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """Mean IoU of all pairs of an object's geometries, a missing one has 0.0; variation of the areas and spread of the centroids of those that exist."""
    names = ("one", "two", "three")
    wide = _predictions(spark, sf).select("id", *names, *(g.area(c(k)).alias("size_" + k) for k in names), *(g.centroid(c(k)).alias("mid_" + k) for k in names))
    both = [(x, y, f"{x}_{y}") for x, y in combinations(names, 2)]
    shared = wide.select("*", *(overlay.common_area(c(x), c(y)).alias(k) for x, y, k in both))
    iou = lambda x, y, k: F.coalesce(F.try_divide(c(k), c("size_" + x) + c("size_" + y) - c(k)), F.lit(0.0))
    pairwise = sum((iou(*p) for p in both), F.lit(0.0)) / len(both)
    known = lambda p: F.filter(F.array(*(F.when(c(k).isNotNull(), c(p + k)) for k in names)), lambda v: v.isNotNull())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    made = shared.select("id", F.round(pairwise, 9).alias("pairwise"), known("size_").alias("sizes"), known("mid_").alias("mids"))
    made = made.withColumns({"mean": mean(c("sizes")), "cx": mean(F.transform("mids", lambda p: p["x"])), "cy": mean(F.transform("mids", lambda p: p["y"]))})
    deviation = F.sqrt(mean(F.transform("sizes", lambda v: (v - c("mean")) * (v - c("mean")))))
    spread = mean(F.transform("mids", lambda p: F.hypot(p["x"] - c("cx"), p["y"] - c("cy"))))
    several = F.size("sizes") > 1
    return made.select("id", "pairwise", F.round(F.when(several & (c("mean") > 0), deviation / c("mean")).otherwise(0.0), 9).alias("area_cv"), F.round(F.when(several, spread).otherwise(0.0), 6).alias("spread"))


def centroid_shift(spark: SparkSession, sf: str) -> DataFrame:
    """How far the new geometry's centroid moved, infinite without one, and by what share its area grew (1 from nothing)."""
    p = _predictions(spark, sf).select("id", g.centroid(c("one")).alias("a"), g.centroid(c("three")).alias("b"), g.area(c("one")).alias("old"), g.area(c("three")).alias("new"))
    return p.select("id", F.round(g.centroid_shift(c("a"), c("b")), 6).alias("shift"), F.round(g.area_diff_frac(c("new"), F.when(c("id") % 10 == 0, 0.0).otherwise(c("old")), 1.0), 9).alias("area_diff"))


def shape_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Which shapes get more prompt points: with a hole, concave, long, or far from compact."""
    s = shapes(b.old_footprints(spark, sf)).select("id", g.holes(c("geometry")).alias("holes"), g.concavity(g.area(c("geometry")), g.hull_area(c("geometry"))).alias("concavity"), F.greatest(c("x1") - c("x0"), c("y1") - c("y0")).alias("long"), F.least(c("x1") - c("x0"), c("y1") - c("y0")).alias("short"), g.compactness(g.area(c("geometry")), g.perimeter(c("geometry"))).alias("compact"))
    return s.select("id", rules.is_complex(c("holes"), c("concavity"), c("long") / c("short"), c("compact"), 0.87, 1.6, 0.6).alias("complex"))


def projected_points(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres of zone 33."""
    s = c("s_suppkey")
    p = t.parquet(spark, sf, "supplier").select(s, (12 + s % 400 / 100).alias("lon"), (50 + s % 500 / 100).alias("lat"))
    return p.withColumn("p", g.utm_from_degrees(c("lon"), c("lat"))).select("s_suppkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def centre_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The middle box of images of different sizes, within their first and last pixels."""
    p = t.parquet(spark, sf, "part").select("p_partkey", (c("p_size") + 1).cast("double").alias("w"), (c("p_partkey") % 40 + 1).cast("double").alias("h"))
    whole, half = g.centre_box(c("w"), c("h"), 1.0), g.centre_box(c("w"), c("h"), 0.5)
    return p.withColumns({"a": whole, "b": half}).select("p_partkey", c("a.x0").alias("left"), c("a.x1").alias("right"), c("a.y1").alias("bottom"), F.round("b.x0", 6).alias("x0"), F.round("b.y0", 6).alias("y0"), F.round("b.x1", 6).alias("x1"), F.round("b.y1", 6).alias("y1"))


def chip_windows_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Square windows about the centroid, twice the longer side and 20 metres, at least 60."""
    s = shapes(b.old_footprints(spark, sf)).withColumn("m", g.centroid(c("geometry")))
    w = g.chip_window(c("x0"), c("y0"), c("x1"), c("y1"), context=2.0, padding=10.0, least=60.0, most=float("inf"), centre=c("m"))
    return s.withColumn("w", w).select("id", *(F.round(f"w.{k}", 6).alias(k) for k in ("left", "bottom", "right", "top")))


def pixel_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Windows in whole pixels of a mosaic, cut to it; those that lie outside are left out."""
    s = shapes(b.new_footprints(spark, sf))
    w = g.chip_window(c("x0").cast("double"), c("y0").cast("double"), c("x1").cast("double"), c("y1").cast("double"))
    crop = g.pixel_crop(c("w"), F.lit(0.0), F.lit(0.0), F.lit(2000.0), F.lit(800.0), 4000, 1600)
    return s.withColumn("w", w).withColumn("p", crop).where("p is not null").select("id", "p.*")


def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of 25 and of more rows than there are: their sizes, whether rows come once, and whether the same seed gives the same rows."""
    some = t.parquet(spark, sf, "supplier").select("s_suppkey")
    parts = [sampling.sample(some, "s_suppkey", n, seed).withColumn("k", F.lit(k)) for k, (n, seed) in enumerate(((5, 42), (5, 42), (100_000, 7)))]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sizes = one.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("ids"))
    same = parts[0].join(parts[1].select("s_suppkey"), "s_suppkey", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("ids")).withColumn("k", F.lit(9))
    return sizes.unionByName(same.select("k", "n", "ids"))


def optional_metric(spark: SparkSession, sf: str) -> DataFrame:
    """A mean of each column of a report, null for one that the report lacks."""
    r = b.reports(spark, sf)
    parts = [ev.mean_or_null(r, name).withColumn("metric", F.lit(name)) for name in ("iou", "shift", "no_such_measure")]
    return ev.united_or_empty(parts, parts[0]).select("metric", F.round("mean", 6).alias("mean"))


def rerank_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Of each object's predicted masks the best by the topology weights; concavity is that of the mask's largest outline against its hull, and the prior's."""
    old = b.old_footprints(spark, sf)
    mask = lambda df: pixel_shapes(df, old).select("id", m.fill(c("geometry"), F.lit(SIDE), F.lit(SIDE)).alias("mask"))
    prior = mask(old).withColumnRenamed("mask", "prior")
    candidates = mask(b.final_footprints(spark, sf)).withColumn("part", F.lit(0)).unionByName(mask(b.new_footprints(spark, sf).where(c("id") < 1_000_000_000)).withColumn("part", F.lit(1)))
    both = candidates.join(prior, "id").select("id", "part", "mask", "prior", m.intersection(c("mask"), c("prior")).alias("common"), m.polygons(m.largest_part(c("mask"))).alias("outline"), m.polygons(c("prior")).alias("prior_outline"))
    sized = both.select("id", "part", *(m.pixels(c(k)).alias(k) for k in ("mask", "prior", "common")), m.bounds(c("mask")).alias("b"), m.bounds(c("prior")).alias("p"), m.centroid(c("mask")).alias("mid"), m.centroid(c("prior")).alias("pmid"), *(g.concavity(g.area(F.slice(k, 1, 1)), g.hull_area(F.slice(k, 1, 1))).alias(k) for k in ("outline", "prior_outline")))
    flat = sized.select("*", *(c(f"b.{k}").alias("b" + k) for k in spatial.BOUNDS), *(c(f"p.{k}").alias("p" + k) for k in spatial.BOUNDS), (c("id") % 7 / 10 + c("part") / 20).alias("sam_score"))
    measures = {
        "prior_iou": F.coalesce(F.try_divide(c("common").cast("double"), c("mask") + c("prior") - c("common")), F.lit(0.0)),
        "area_consistency": ranking.area_consistency(c("mask"), c("prior")),
        "bbox_iou_prior": g.box_iou("b", "p"),
        "centroid_consistency": ranking.centroid_consistency(F.hypot(c("mid.x") - c("pmid.x"), c("mid.y") - c("pmid.y")), F.lit(SIDE * 2**0.5)),
        "shape_match": ranking.shape_match(c("outline"), c("prior_outline")),
    }
    score = F.round(ranking.weighted(ranking.TOPOLOGY), 9)
    best = ranking.best_candidate(flat.withColumns(measures), "id", "part", score, c("mask") > 0, F.round("sam_score", 9))
    return best.select("id", "part", "combined", "reranked")


# images ------------------------------------------------------------------------------------------------------


def image_gamma(spark: SparkSession, sf: str) -> DataFrame:
    """Chips with their grey values raised to a power."""
    chips = b.old_footprints(spark, sf).select("id", chip_image().alias("image"))
    made = chips.select("id", images.gamma_corrected(c("image"), F.when(c("id") % 2 == 0, 0.5).otherwise(2.0)).alias("image"))
    return made.select("id", F.sha2("image", 256).alias("digest"))


def class_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of one class of a label image."""
    chips = b.old_footprints(spark, sf).where("id % 5 = 0").select("id", chip_image().alias("image"))
    made = chips.select("id", images.class_mask(c("image"), F.lit(SIDE), c("id") % 7).alias("mask"))
    return made.select("id", F.size("mask").alias("runs"), m.pixels(c("mask")).alias("pixels"), F.aggregate("mask", F.lit(0).cast("long"), lambda s, r: s + r["y"] * 64 + r["x0"]).alias("places"))


def colour_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of one colour of colour-coded labels, and those of the grey chips of the same objects after two preprocessings of a config."""
    value = lambda i: F.concat(F.lpad(F.hex((i + c("id")) % 5), 2, "0"), F.lpad(F.hex(F.floor(i / SIDE) % 3), 2, "0"), F.lit("07"))
    coded = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), value), ""))
    chips = b.old_footprints(spark, sf).where("id % 5 = 2").select("id", coded.alias("labels"), chip_image().alias("image"))
    made = chips.select("id", images.colour_mask(c("labels"), F.lit(SIDE), (3, 1, 7)).alias("mask"), images.preprocessed(c("image"), {"mode": "gamma", "gamma": 2.0}).alias("dark"), images.preprocessed(c("image"), {}).alias("same"))
    return made.select("id", F.size("mask").alias("runs"), m.pixels(c("mask")).alias("pixels"), F.sha2("dark", 256).alias("dark"), F.sha2("same", 256).alias("same"))


def image_resized(spark: SparkSession, sf: str) -> DataFrame:
    """Chips made half and twice as large, bilinear."""
    chips = t.dealt(b.old_footprints(spark, sf).where("id % 5 = 1")).select("id", chip_image().alias("image"))
    made = chips.select("id", images.resized(c("image"), F.lit(SIDE), F.when(c("id") % 2 == 0, 32).otherwise(128)).alias("image"))
    return made.select("id", F.sha2("image", 256).alias("digest"))


# sources and sinks -------------------------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Objects written as CSV, with the geometry as text, and read with types; quotes, commas, line breaks and nulls stay."""
    p = t.parquet(spark, sf, "part").select(c("p_partkey").alias("id"), F.concat(c("p_name"), F.lit(', "'), c("p_brand"), F.lit('"\n'), c("p_type")).alias("name"), F.when(c("p_partkey") % 3 > 0, c("p_retailprice")).alias("price"), (c("p_size") > 20).alias("large"))
    old = shapes(t.dealt(b.old_footprints(spark, sf))).select("id", "geometry")
    path = t.new_path(spark, "csv")
    t.write_csv(t.dealt(p).join(t.merging(old), "id"), path, keep_wkt=True)
    read = t.csv(spark, path, "id long, name string, price double, large boolean, geometry string")
    return read.select("id", "name", "price", "large", F.round(g.area(g.parse_wkt(c("geometry"))), 6).alias("size"))


def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes written as GeoJSON features and read again."""
    path = t.new_path(spark, "geojson")
    t.write_geojson(shapes(b.old_footprints(spark, sf)).select("id", F.when(c("id") % 4 > 0, c("x0")).alias("x0"), "geometry"), path)
    return t.geojson_lines(spark, path, "id long, x0 long").select("id", "x0", F.round(g.area(c("geometry")), 6).alias("size"), g.holes(c("geometry")).alias("holes"))


def layer_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset of layers by size, of which empty ones aren't written; the wanted layer and, where there is none of that name, the first."""
    p = t.parquet(spark, sf, "part").select("p_partkey", "p_size")
    path = t.new_path(spark, "layers")
    kept = t.write_layers(path, {"small": p.where("p_size < 20"), "none": p.where("p_size > 1000"), "large": p.where("p_size >= 20")})
    wanted, absent = t.layer(spark, path, "small"), t.layer(spark, path, "none")
    return wanted.select("p_partkey", F.lit("small").alias("asked"), F.lit(",".join(kept)).alias("layers")).unionByName(absent.select("p_partkey", F.lit("none").alias("asked"), F.lit(",".join(kept)).alias("layers")))


def optional_source(spark: SparkSession, sf: str) -> DataFrame:
    """A table that may not be there, an optional column, and rows of a config in place of a file."""
    s = t.parquet(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    path = t.new_path(spark, "optional")
    t.write_csv(s, path)
    found, missing = t.optional_csv(spark, path, "id long, name string"), t.optional_csv(spark, path + "-none", "id long")
    plan = t.csv_or_rows(spark, path + "-none", "id long, points string", [(3, "[[1,2]]"), (5, "[]")])
    whole = t.require_rows(t.require_columns(t.with_optional(found, "note", "string"), {"id", "name"}), "suppliers")
    return whole.join(plan, "id", "left").select("id", "name", "note", "points", F.lit(missing is None).alias("absent"))


def config_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written beside the settings that made them, and both read again."""
    path = t.new_path(spark, "config")
    t.write_with_config(t.parquet(spark, sf, "supplier").select("s_suppkey"), path, {"seed": 42, "share": 0.5})
    settings = spark.read.text(f"{path}/config").select(F.from_json("value", "seed int, share double").alias("s"))
    return spark.read.parquet(f"{path}/rows").crossJoin(F.broadcast(settings)).select("s_suppkey", "s.seed", "s.share")  # one row of settings


QUERIES = (
    geometry_uncertainty, centroid_shift, shape_complexity, projected_points, centre_prompts, chip_windows_fixed, pixel_crops, sample_sizes, optional_metric, rerank_shapes, image_gamma, class_masks, colour_masks, image_resized,
    csv_round_trip, geojson_round_trip, layer_round_trip, optional_source, config_sink,
)


def oracle_sql(old: str, new: str, final: str, report: str, boxes) -> dict[str, str]:
    d = lambda x: f"{x}::DOUBLE"
    near = f"{new}, near AS (SELECT * FROM new WHERE id < 1000000000), kept AS (SELECT * FROM final WHERE id % 11 > 0)"
    ob, sb, nb = boxes("ob", "old"), boxes("sb", "kept"), boxes("nb", "near")
    sums = "SELECT p.id, sum(greatest(0, least(p.c, q.c) - greatest(p.a, q.a)) * greatest(0, least(p.d, q.d) - greatest(p.b, q.b)))::DOUBLE AS common FROM {0} p JOIN {1} q USING (id) GROUP BY 1"
    iou = lambda k, x, y: f"i{k} AS (SELECT id, common / (p.size + q.size - common) AS iou FROM ({sums.format(x, y)}) JOIN {x}_m p USING (id) JOIN {y}_m q USING (id))"
    shape = f"s AS (SELECT *, id % 3 AS k, x1 - x0 AS w, y1 - y0 AS h, x1 - (x0 + x1) // 2 AS nw, y1 - (y0 + y1) // 2 AS nh FROM old), {ob}"
    grey = "px AS (SELECT id, y, x, (x * x + 3 * y + id) % 256 AS v FROM {0}, range(64) t(x), range(64) u(y))"
    blob = "sha256(unhex(string_agg(printf('%02x', {0}), '' ORDER BY y, x)))"
    chip = lambda name, of: f"{name} AS (SELECT f.id, f.x0 - o.x0 + 8 AS x0, f.y0 - o.y0 + 8 AS y0, f.x1 - o.x0 + 8 AS x1, f.y1 - o.y0 + 8 AS y1, f.id % 3 AS k, (f.x0 + f.x1 - 2 * o.x0 + 16) // 2 AS mx, (f.y0 + f.y1 - 2 * o.y0 + 16) // 2 AS my FROM {of} f JOIN old o USING (id))"
    inside = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (k = 0 OR k = 1 AND (x <= mx OR y <= my) OR k = 2 AND NOT (x BETWEEN x0 + 3 AND x1 - 3 AND y BETWEEN y0 + 3 AND y1 - 3))"
    pixels = lambda name, of: f"{name} AS MATERIALIZED (SELECT id, part, k, mx, my, x, y FROM {of} JOIN range(64) t(x) ON true JOIN range(64) u(y) ON {inside})"
    # an outline's hull: its bounds less the triangle over the notch that is left of an L
    measured = lambda name, of: f"{name} AS (SELECT *, size / (w * h - CASE WHEN k = 1 AND nw > 0 AND nh > 0 THEN nw * nh / {d(2)} ELSE 0 END) AS conc FROM (SELECT id, part, k, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, max(x) - any_value(mx) AS nw, max(y) - any_value(my) AS nh FROM {of} GROUP BY 1, 2, 3))"
    axis = lambda v, n, size: f"greatest(0, least({size} - 1, ({v} + {d(0.5)}) * {size} / {n} - {d(0.5)}))"
    return {
        "geometry_uncertainty": f"""WITH {old}, {final}, {near}, {ob}, {sb}, {nb}, {iou(1, 'ob', 'sb')}, {iou(2, 'ob', 'nb')}, {iou(3, 'sb', 'nb')},
          v AS (SELECT id, size, cx, cy FROM ob_m UNION ALL SELECT id, size, cx, cy FROM sb_m UNION ALL SELECT id, size, cx, cy FROM nb_m), a AS (SELECT id, count(*) AS n, avg(size) AS mean, stddev_pop(size) AS dev, avg(cx) AS mx, avg(cy) AS my FROM v GROUP BY 1),
          f AS (SELECT v.id, avg(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) AS spread FROM v JOIN a USING (id) GROUP BY 1)
          SELECT id, round((coalesce(i1.iou, 0) + coalesce(i2.iou, 0) + coalesce(i3.iou, 0)) / 3, 9) AS pairwise, round(CASE WHEN n > 1 THEN dev / mean ELSE 0 END, 9) AS area_cv, round(CASE WHEN n > 1 THEN spread ELSE 0 END, 6) AS spread
          FROM old LEFT JOIN i1 USING (id) LEFT JOIN i2 USING (id) LEFT JOIN i3 USING (id) JOIN a USING (id) JOIN f USING (id)""",
        "centroid_shift": f"WITH {old}, {final}, {near}, {ob}, {nb} SELECT id, coalesce(round(sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)), 6), 'Infinity'::DOUBLE) AS shift, CASE WHEN id % 10 = 0 THEN 1.0::DOUBLE ELSE round((q.size - p.size) / p.size, 9) END AS area_diff FROM ob_m p LEFT JOIN nb_m q USING (id)",
        "shape_complexity": f"""WITH {old}, {shape} SELECT id, k = 2 OR k = 1 AND size / (w * h - nw * nh / {d(2)}) < 0.87::DOUBLE OR greatest(w, h) / least(w, h)::DOUBLE > 1.6::DOUBLE OR 4 * pi() * size / pow(2 * (w + h) + CASE WHEN k = 2 THEN 2 * (w + h - 12) ELSE 0 END, 2) < 0.6::DOUBLE AS complex FROM s JOIN ob_m USING (id)""",
        "projected_points": f"""WITH p AS (SELECT s_suppkey, radians(12 + (s_suppkey % 400) / {d(100)} - 15) AS dl, sin(radians(50 + (s_suppkey % 500) / {d(100)})) AS s FROM supplier),
          k AS (SELECT *, {d(1)} / {d('298.257222101')} / (2 - {d(1)} / {d('298.257222101')}) AS n FROM p), e AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e, 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM k),
          q AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM e), z AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM q),
          a AS (SELECT *, [n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 + 41 * n * n * n * n / 180, 13 * n * n / 48 - 3 * n * n * n / 5 + 557 * n * n * n * n / 1440, 61 * n * n * n / 240 - 103 * n * n * n * n / 140, 49561 * n * n * n * n / 161280] AS al FROM z)
          SELECT s_suppkey, round(500000 + {d('0.9996')} * r * (eta + list_sum(list_transform(range(1, 5), lambda j: al[j] * cos(2 * j * xi) * sinh(2 * j * eta)))), 3) AS x, round({d('0.9996')} * r * (xi + list_sum(list_transform(range(1, 5), lambda j: al[j] * sin(2 * j * xi) * cosh(2 * j * eta)))), 3) AS y FROM a""",
        "centre_prompts": f'SELECT p_partkey, 0.0::DOUBLE AS "left", p_size::DOUBLE AS "right", (p_partkey % 40)::DOUBLE AS bottom, round((p_size + 1) / {d(4)}, 6) AS x0, round((p_partkey % 40 + 1) / {d(4)}, 6) AS y0, round(least(p_size, 3 * (p_size + 1) / {d(4)}), 6) AS x1, round(least(p_partkey % 40, 3 * (p_partkey % 40 + 1) / {d(4)}), 6) AS y1 FROM part',
        "chip_windows_fixed": f'WITH {old}, {shape}, v AS (SELECT id, cx, cy, greatest(60, 2 * greatest(w, h) + 20) / {d(2)} AS half FROM s JOIN ob_m USING (id)) SELECT id, round(cx - half, 6) AS "left", round(cy - half, 6) AS bottom, round(cx + half, 6) AS "right", round(cy + half, 6) AS top FROM v',
        "pixel_crops": f"""WITH {new}, v AS (SELECT id, (x0 + x1) / {d(2)} AS cx, (y0 + y1) / {d(2)} AS cy, least(greatest(greatest(x1 - x0, y1 - y0) * {d('1.35')} + 12, 35), 110) / 2 AS half FROM new),
          p AS (SELECT id, greatest(0, floor(round((cx - half) * 2, 6)))::BIGINT AS x0, greatest(0, floor(round((800 - cy - half) * 2, 6)))::BIGINT AS y0, least(4000, ceil(round((cx + half) * 2, 6)))::BIGINT AS x1, least(1600, ceil(round((800 - cy + half) * 2, 6)))::BIGINT AS y1 FROM v) SELECT * FROM p WHERE x0 < x1 AND y0 < y1""",
        "sample_sizes": "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT k, CASE WHEN k = 2 THEN n ELSE least(n, 5) END AS n, CASE WHEN k = 2 THEN n ELSE least(n, 5) END AS ids FROM n, (VALUES (0), (1), (2), (9)) t(k)",
        "optional_metric": f"WITH {report} SELECT 'iou' AS metric, round(avg(iou), 6) AS mean FROM r UNION ALL SELECT 'shift', round(avg(shift), 6) FROM r UNION ALL SELECT 'no_such_measure', NULL",
        "rerank_shapes": f"""WITH {old}, {final}, {near}, p AS (SELECT *, 0 AS part FROM ({chip('z', 'old').split(' AS ', 1)[1]})), f AS (SELECT *, 0 AS part FROM ({chip('z', 'final').split(' AS ', 1)[1]}) UNION ALL SELECT *, 1 FROM ({chip('z', 'near').split(' AS ', 1)[1]})),
          {pixels('a', 'f')}, {pixels('o', 'p')}, {measured('am', 'a')}, {measured('om', 'o')}, c AS (SELECT a.id, a.part, count(o.id) AS common FROM a LEFT JOIN o ON a.id = o.id AND a.x = o.x AND a.y = o.y GROUP BY 1, 2),
          q AS (SELECT am.*, common, om.size AS prior, om.conc AS pconc, om.cx AS px, om.cy AS py, om.x0 AS u0, om.y0 AS v0, om.x1 AS u1, om.y1 AS v1, (am.id % 7) / {d(10)} + am.part / {d(20)} AS sam FROM am JOIN om USING (id) JOIN c ON c.id = am.id AND c.part = am.part),
          r AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS bo FROM q),
          w AS (SELECT id, part, round({d('0.2')} * sam + {d('0.3')} * common / (size + prior - common) + {d('0.2')} * greatest(0, 1 - abs(size / {d('prior')} - 1)) + {d('0.15')} * coalesce(bo / nullif(((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - bo)::DOUBLE, 0), 0)
            + {d('0.1')} * greatest(0, 1 - sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / ({d('0.35')} * sqrt({d(8192)}))) + {d('0.05')} * greatest(0, 1 - abs(conc - pconc)), 9) AS combined FROM r)
          SELECT id, part, combined, true AS reranked FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY combined DESC, part) = 1""",
        "image_gamma": f"WITH {old}, {grey.format('old')} SELECT id, {blob.format(f'trunc(pow(v / {d(255)}, CASE WHEN id % 2 = 0 THEN {d(0.5)} ELSE {d(2)} END) * 255)::INT')} AS digest FROM px GROUP BY id",
        "class_masks": f"""WITH {old}, five AS (SELECT * FROM old WHERE id % 5 = 0), {grey.format('five')}, h AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS isle FROM px WHERE v = id % 7), r AS (SELECT id, y, isle, min(x) AS x0, count(*) AS n FROM h GROUP BY ALL)
          SELECT five.id, count(r.id) AS runs, coalesce(sum(n), 0)::BIGINT AS pixels, coalesce(sum(y * 64 + r.x0), 0)::BIGINT AS places FROM five LEFT JOIN r USING (id) GROUP BY 1""",
        "colour_masks": f"""WITH {old}, five AS (SELECT * FROM old WHERE id % 5 = 2), {grey.format('five')}, n AS (SELECT id, count(*) AS pixels FROM px WHERE (y * 64 + x + id) % 5 = 3 AND y % 3 = 1 GROUP BY 1)
          SELECT id, pixels AS runs, pixels, {blob.format(f'trunc(pow(v / {d(255)}, 2) * 255)::INT')} AS dark, {blob.format('v')} AS same FROM px JOIN n USING (id) GROUP BY id, pixels""",
        "image_resized": f"""WITH {old}, five AS (SELECT id, CASE WHEN id % 2 = 0 THEN 32 ELSE 128 END AS n FROM old WHERE id % 5 = 1), g AS (SELECT id, n, y, x, {axis('y', 'n', 64)} AS py, {axis('x', 'n', 64)} AS px FROM five, range(128) t(x), range(128) u(y) WHERE x < n AND y < n),
          f AS (SELECT *, least(floor(py), 62)::INT AS y0, least(floor(px), 62)::INT AS x0 FROM g), v AS (SELECT id, y, x, py - y0 AS fy, px - x0 AS fx, (x0 * x0 + 3 * y0 + id) % 256 AS a, (x0 * x0 + 3 * (y0 + 1) + id) % 256 AS b, ((x0 + 1) * (x0 + 1) + 3 * y0 + id) % 256 AS c, ((x0 + 1) * (x0 + 1) + 3 * (y0 + 1) + id) % 256 AS d FROM f)
          SELECT id, {blob.format('round_even((a * (1 - fy) + b * fy) * (1 - fx) + (c * (1 - fy) + d * fy) * fx, 0)::INT')} AS digest FROM v GROUP BY id""",
        "csv_round_trip": f"WITH {old}, {ob} SELECT p_partkey AS id, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS name, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS price, p_size > 20 AS \"large\", size FROM part JOIN ob_m ON id = p_partkey",
        "geojson_round_trip": f"WITH {old}, {ob} SELECT id, CASE WHEN id % 4 > 0 THEN x0 END AS x0, size, CASE WHEN id % 3 = 2 THEN 1 ELSE 0 END AS holes FROM old JOIN ob_m USING (id)",
        "layer_round_trip": "SELECT p_partkey, 'small' AS asked, 'small,large' AS layers FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, 'none', 'small,large' FROM part WHERE p_size >= 20",
        "optional_source": "SELECT s_suppkey AS id, s_name AS name, NULL AS note, CASE s_suppkey WHEN 3 THEN '[[1,2]]' WHEN 5 THEN '[]' END AS points, true AS absent FROM supplier",
        "config_sink": "SELECT s_suppkey, 42 AS seed, 0.5::DOUBLE AS share FROM supplier",
    }
