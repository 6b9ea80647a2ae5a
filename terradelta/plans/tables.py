"""Queries for joins, numbers, paths, reports and rankings over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import evaluation as ev
from ..operators import ranking, rules, sampling
from ..sources import tables as src
from ..sources.tables import parquet
from . import bindings as b

c = F.col
IMAGE = 30  # pixels of a side


def _masks(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate masks of each object (an order) from its lines: a box of pixels less a notch, beside the object's prior box."""
    n = parquet(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("id"), c("l_linenumber").alias("part")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").cast("long").alias("q"))
    box = n.select("id", "part", (c("p") % 100 / 100).alias("sam_score"), c("p") % 15, (c("s") % 15).alias("my0"), (c("q") % 14).alias("w"), (4 + c("s") % 9).alias("h"), (c("p") % 3).alias("notch"), (c("p") % 7 / 7).alias("concavity")).toDF("id", "part", "sam_score", "mx0", "my0", "w", "h", "notch", "concavity")
    prior = box.withColumns({"mx1": c("mx0") + c("w"), "my1": c("my0") + c("h"), "px0": c("id") % 12, "py0": c("id") % 10, "px1": c("id") % 12 + 11, "py1": c("id") % 10 + 8})
    size = F.greatest(c("w") * c("h") - c("notch"), F.lit(0))
    whole = g.box_overlap("m", "p")
    d2 = (c("mx0") + c("mx1") - c("px0") - c("px1")) ** 2 + (c("my0") + c("my1") - c("py0") - c("py1")) ** 2
    wide = prior.select("id", "part", "sam_score", "w", "h", "concavity", size.alias("size"), F.lit(88).cast("long").alias("prior"), F.greatest(F.least(whole, whole - c("notch")), F.lit(0)).cast("long").alias("inter"), g.box_iou("m", "p").alias("bbox_iou_prior"), (F.sqrt(d2) / 2).alias("distance"), (F.sqrt((c("mx0") + c("mx1") - IMAGE) ** 2 + (c("my0") + c("my1") - IMAGE) ** 2) / 2).alias("off"))
    return wide.withColumns(ranking.overlap_measures(c("inter"), c("size"), c("prior"))).withColumns({"area_consistency": ranking.area_consistency(c("size"), c("prior")), "compactness": ranking.fill_ratio(c("size"), c("w"), c("h")), "prior_iou": c("iou_prior")})


def _ranked(masks: DataFrame, weights: dict[str, float], usable: Column) -> DataFrame:
    best = ranking.best_candidate(masks, "id", "part", F.round(ranking.weighted(weights), 9), usable, F.round("sam_score", 9))
    return best.select("id", "part", "combined", "reranked")


def _diagonal() -> Column:
    return F.sqrt(F.lit(2.0 * IMAGE * IMAGE))


def rerank_topology(spark: SparkSession, sf: str) -> DataFrame:
    m = _masks(spark, sf).withColumns({"centroid_consistency": ranking.centroid_consistency(c("distance"), _diagonal()), "shape_match": ranking.shape_match(c("concavity"), F.lit(1.0))})
    return _ranked(m, ranking.TOPOLOGY, c("size") > 0)


def rerank_shadow(spark: SparkSession, sf: str) -> DataFrame:
    m = _masks(spark, sf).withColumn("centroid_consistency", ranking.centroid_consistency(c("distance"), _diagonal()))
    return _ranked(m, ranking.SHADOW, c("size") > 0)


def rerank_new_buildings(spark: SparkSession, sf: str) -> DataFrame:
    m = _masks(spark, sf).withColumns({"centeredness": ranking.centredness(c("off"), _diagonal()), "area_reasonableness": ranking.area_reasonableness(c("size") / (IMAGE * IMAGE), *ranking.NEW_BUILDING_AREA), "compactness_proxy": c("compactness")})
    return _ranked(m, ranking.NEW_BUILDING, c("size") > 0)


def rerank_prior_guided(spark: SparkSession, sf: str) -> DataFrame:
    """An empty mask has the score 0, and the best is chosen among all."""
    m = _masks(spark, sf)
    score = F.round(F.when(c("size") > 0, ranking.weighted(ranking.PRIOR_GUIDED)).otherwise(0.0), 9)
    return ranking.best_candidate(m, "id", "part", score, F.lit(True), score).select("id", "part", "combined")


def mask_fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _masks(spark, sf).select("id", "part", F.round("compactness", 9).alias("fill"))


def join_suffix_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """A report's own route where it has one, else the routing table's of the same name."""
    report = parquet(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("object"), F.when(c("o_orderstatus") != "F", c("o_orderstatus")).alias("route"))
    routing = parquet(spark, sf, "customer").select(c("c_custkey").alias("object"), F.when(c("c_custkey") % 4 > 0, c("c_mktsegment")).alias("route"))
    both = report.join(routing.withColumnRenamed("route", "route_route"), "object", "left")
    return both.select("id", "object", F.coalesce("route", "route_route").alias("route"))


def manifest_context(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluated objects with five columns of a manifest that lacks some of them."""
    evaluated = b.reports(spark, sf).groupBy("object").agg(F.round(F.avg("iou"), 6).alias("iou")).withColumnRenamed("object", "id")
    manifest = parquet(spark, sf, "part").where("p_partkey % 9 > 0").select(c("p_partkey").alias("id"), c("p_brand").alias("status"), c("p_size").alias("size"), c("p_name").alias("kind"), c("p_type").alias("type"))
    return evaluated.join(manifest, "id", "left").select("id", "iou", "status", "size", "kind", "type")


def last_duplicate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Ids once read as floats find the last of the entries that share them."""
    entries = parquet(spark, sf, "orders").groupBy(c("o_custkey").alias("key")).agg(F.max_by("o_orderdate", "o_orderkey").alias("found"), F.max("o_orderkey").alias("entry"))
    asked = parquet(spark, sf, "customer").select(c("c_custkey").alias("id"), t.normal_id(F.when(c("c_custkey") % 7 > 0, F.concat(c("c_custkey"), F.lit(".0"))).otherwise(F.concat(c("c_custkey"), F.lit("x")))).alias("key"))
    return asked.join(entries, "key", "left").select("id", "key", "entry", F.date_format("found", "yyyy-MM-dd").alias("found"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "part").select(F.concat(F.lit("train\\img/"), c("p_partkey"), F.lit(".v1.tif")).alias("path"))


def stem_join(spark: SparkSession, sf: str) -> DataFrame:
    """Images and masks of one file stem."""
    masks = parquet(spark, sf, "supplier").select(F.concat(F.lit("masks/"), c("s_suppkey") * 3, F.lit(".v1.png")).alias("mask"))
    images = _images(spark, sf).select("path", t.stem(c("path")).alias("stem"), t.top_folder(c("path")).alias("folder"))
    return images.join(masks.withColumn("stem", t.stem(c("mask"))), "stem").select("stem", "folder", "mask")


def path_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Old paths, some of another machine, against a listing of files that exist."""
    k = c("p_partkey")
    listing = parquet(spark, sf, "part").where(k % 5 > 0).select(F.concat(F.lit("/data/chips/"), k, F.lit(".png")).alias("path"))
    asked = parquet(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("/data/chips/"), k, F.lit(".png"))).when(k % 3 == 1, F.concat(F.lit("chips/"), k, F.lit(".png"))).otherwise(F.concat(F.lit("C:\\old\\project\\chips\\"), k, F.lit(".png"))).alias("path"))
    return src.resolved(asked, listing, "/data", ["/project-main/", "/project/"])


def first_folder_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each object's chip in the first folder that has it."""
    s = c("s_suppkey") * 313  # of one to six digits
    of = lambda folder, m: parquet(spark, sf, "supplier").where(s % m == 0).select(F.concat(F.lit(folder + "/"), F.when(s < 1000, F.lpad(s.cast("string"), 4, "0")).otherwise(s.cast("string")), F.lit(".png")).alias("path"))
    listing = of("tight", 3).unionByName(of("wide", 2)).unionByName(of("other", 1).where(F.length("path") < 12))
    return src.in_first_folder(parquet(spark, sf, "supplier").select(s.alias("id")), listing, ["tight", "wide"])


def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A subset numbered from 1 in order."""
    some = parquet(spark, sf, "supplier").where("s_acctbal > 5000").select("s_suppkey")
    return sampling.ordinals(some, ["s_suppkey"], "n").select("s_suppkey", (c("n") + 1).alias("subset_id"))


def ordinal_key(spark: SparkSession, sf: str) -> DataFrame:
    """A row's place in its table as its key."""
    return sampling.ordinals(parquet(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "row_idx").select("o_orderkey", "row_idx")


def gap_keeping_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered before the filter, so the numbers that are left have gaps."""
    return sampling.ordinals(parquet(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"], "n").where("p_size > 25").select((c("n") + 1).alias("id"), "p_partkey")


def final_geometry_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The original or the predicted geometry, by the source that the decision names."""
    source = F.when(c("id") % 4 == 0, "OSM").when(c("id") % 4 == 1, "sam2").when(c("id") % 4 == 2, "keep")
    old = b.old_footprints(spark, sf).select("id", g.box_wkt(*(c(k) for k in ("x0", "y0", "x1", "y1"))).alias("orig_wkt"))
    new = b.final_footprints(spark, sf).select("id", g.box_wkt(*(c(k) for k in ("x0", "y0", "x1", "y1"))).alias("pred_wkt"))
    return old.join(new, "id").select("id", rules.final_geometry(source, c("orig_wkt"), c("pred_wkt")).alias("wkt"))


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen ids (listed twice in the config) beside three reports, one of which lacks some."""
    chosen = spark.createDataFrame([([5, 3, 8, 5, 21, 34, 3],)], "ids array<bigint>").select(F.explode(F.array_distinct("ids")).alias("id"))
    best = parquet(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("decision"))
    change = parquet(spark, sf, "part").where("p_partkey % 2 = 1").select(c("p_partkey").alias("id"), c("p_type").alias("change"))
    external = parquet(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_size").alias("measure"))
    return chosen.join(best, "id").join(change, "id", "left").join(external, "id").select("id", "decision", F.coalesce("change", F.lit("")).alias("change"), "measure").orderBy("id")


def checked_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Those of the wanted columns that exist, of rows with a polygon of a polygon's type."""
    kind = F.when(c("id") % 5 == 0, "Point").when(c("id") % 5 == 1, "MultiPolygon").otherwise("Polygon")
    wkt = F.when(c("id") % 7 > 0, g.box_wkt(*(c(k) for k in ("x0", "y0", "x1", "y1"))))
    df = b.old_footprints(spark, sf).select("id", kind.alias("kind"), g.parse_wkt(wkt).alias("geometry"), "x0", "y0")
    return src.existing(src.buildings(df, "geometry", "kind"), ["id", "name", "kind", "x0", "height"])


def date_slices(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "orders").select("o_orderkey", t.compact_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("day"))


def report_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as a report prints them, sorted by the highest mean first."""
    e = b.experiments(spark, sf).groupBy("experiment").agg((F.sum(F.col("key")) % 997 / 8).alias("m"), F.count("*").alias("n"))
    return e.orderBy(c("m").desc(), "experiment").select("experiment", F.concat_ws(" ", t.fixed(c("m")), t.fixed(c("m") - 50, 3, True), t.fixed(F.when(c("n") < 0, c("m")))).alias("line"))


def fixed_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of fixed decisions in a table, in one without the column and in one that isn't there."""
    labels = ("keep", "update", "flag_review")
    some = parquet(spark, sf, "orders").select(F.when(c("o_orderstatus") == "F", "keep").when(c("o_orderstatus") == "O", "update").alias("decision"))
    parts = [ev.fixed_counts(df, "decision", labels, spark).withColumn("k", F.lit(i)) for i, df in enumerate((some, some.select(F.lit(1).alias("x")), None))]
    return ev.united_or_empty(parts, parts[0])


def conditional_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Strata that have rows, united; none has, so the result is empty but has its columns."""
    df = parquet(spark, sf, "part").select("p_partkey", "p_brand")
    wanted = [x for x in ("no such brand", "nor this one") if not df.where(c("p_brand") == x).isEmpty()]
    return ev.united_or_empty([df.where(c("p_brand") == x) for x in wanted], df)


def conditional_union(spark: SparkSession, sf: str) -> DataFrame:
    """Strata that have rows, united: some of the wanted ones have none."""
    df = parquet(spark, sf, "part").select("p_partkey", "p_brand")
    wanted = [x for x in ("Brand#13", "no such brand", "Brand#5") if not df.where(c("p_brand") == x).isEmpty()]
    return ev.united_or_empty([df.where(c("p_brand") == x) for x in wanted], df)


def rounded_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points that are equal to a tenth count once, the first stays."""
    k = c("l_orderkey") * 10 + c("l_linenumber")
    points = parquet(spark, sf, "lineitem").groupBy(k.alias("k")).agg((F.max("l_partkey") % 40 / 16).alias("x"), (F.max("l_suppkey") % 40 / 16).alias("y"))
    return sampling.first_of_rounded(points, {"x": 1, "y": 1}, "k")


def prompt_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of an object's positive and negative prompt points, in one list."""
    n = parquet(spark, sf, "part").select("p_partkey", (c("p_size") % 4).alias("p"), (c("p_partkey") % 3).cast("int").alias("m"))
    labels = F.concat(F.array_repeat(F.lit(1), c("p")), F.array_repeat(F.lit(0), c("m")))
    return n.select("p_partkey", F.array_join(labels, "").alias("labels"))


def centre_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of an object's centres, over its experiments, to their mean."""
    points = parquet(spark, sf, "orders").select(c("o_custkey").alias("id"), (c("o_orderkey") % 100).alias("x"), (c("o_orderkey") % 37).alias("y"))
    return ev.spread(points, "id", "x", "y").select("id", F.round("spread", 6).alias("spread"))


QUERIES = (
    rerank_topology, rerank_shadow, rerank_new_buildings, rerank_prior_guided, mask_fill_ratio, join_suffix_coalesce, manifest_context, last_duplicate_lookup, stem_join, path_resolution, first_folder_lookup,
    dense_numbers, ordinal_key, gap_keeping_ordinal, final_geometry_choice, case_table, checked_scan, date_slices, report_numbers, fixed_category_counts, conditional_empty, conditional_union, rounded_points, prompt_labels, centre_spread,
)


def oracle_sql(old: str, final: str, report: str, exp: str) -> dict[str, str]:
    masks = """n AS (SELECT l_orderkey AS id, l_linenumber AS part, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
      bx AS (SELECT id, part, (p % 100)::DOUBLE / 100 AS sam, p % 15 AS x0, s % 15 AS y0, q % 14 AS w, 4 + s % 9 AS h, p % 3 AS notch, (p % 7)::DOUBLE / 7 AS conc, id % 12 AS px, id % 10 AS py FROM n),
      ov AS (SELECT *, greatest(w * h - notch, 0)::BIGINT AS size, greatest(0, least(x0 + w, px + 11) - greatest(x0, px)) * greatest(0, least(y0 + h, py + 8) - greatest(y0, py)) AS whole FROM bx),
      ms AS (SELECT *, greatest(whole - notch, 0)::BIGINT AS inter, whole::DOUBLE / (w * h + 88 - whole) AS bbox, sqrt((x0 + x0 + w - px - px - 11) * (x0 + x0 + w - px - px - 11) + (y0 + y0 + h - py - py - 8) * (y0 + y0 + h - py - py - 8)) / 2 AS dist,
        sqrt((x0 + x0 + w - 30) * (x0 + x0 + w - 30) + (y0 + y0 + h - 30) * (y0 + y0 + h - 30)) / 2 AS off FROM ov),
      mm AS (SELECT *, inter::DOUBLE / (size + 88 - inter) AS iou, CASE WHEN size > 0 THEN inter::DOUBLE / size ELSE 0 END AS prec, inter::DOUBLE / 88 AS rec, greatest(0, 1 - abs(size::DOUBLE / 88 - 1)) AS cons, size::DOUBLE / greatest(w * h, 1) AS fill,
        greatest(0, 1 - dist / (0.35::DOUBLE * sqrt(1800::DOUBLE))) AS centroid, greatest(0, 1 - off / (0.3::DOUBLE * sqrt(1800::DOUBLE))) AS middle, size::DOUBLE / 900 AS share FROM ms),
      mr AS (SELECT *, CASE WHEN share BETWEEN 0.01 AND 0.4 THEN greatest(0, 1 - abs(share - 0.205::DOUBLE) / 0.195::DOUBLE) ELSE 0 END AS reason FROM mm)"""

    def ranked(score: str) -> str:
        s = f"CASE WHEN size > 0 THEN round({score}, 9) ELSE round(sam, 9) END"
        return f"WITH {masks} SELECT id, part, {s} AS combined, size > 0 AS reranked FROM mr QUALIFY row_number() OVER (PARTITION BY id ORDER BY size > 0 DESC, {s} DESC, part) = 1"

    d = lambda x: f"{x}::DOUBLE"
    prior = f"CASE WHEN size > 0 THEN round({d(0.3)} * iou + {d(0.2)} * prec + {d(0.2)} * rec + {d(0.2)} * cons + {d(0.1)} * sam, 9) ELSE 0 END"
    wkt = "'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))'"
    return {
        "rerank_topology": ranked(f"{d(0.2)} * sam + {d(0.3)} * iou + {d(0.2)} * cons + {d(0.15)} * bbox + {d(0.1)} * centroid + {d(0.05)} * greatest(0, 1 - abs(conc - 1))"),
        "rerank_shadow": ranked(f"{d(0.25)} * sam + {d(0.25)} * iou + {d(0.25)} * cons + {d(0.15)} * centroid + {d(0.1)} * fill"),
        "rerank_new_buildings": ranked(f"{d(0.25)} * sam + {d(0.35)} * middle + {d(0.25)} * reason + {d(0.15)} * fill"),
        "rerank_prior_guided": f"WITH {masks} SELECT id, part, {prior} AS combined FROM mr QUALIFY row_number() OVER (PARTITION BY id ORDER BY {prior} DESC, part) = 1",
        "mask_fill_ratio": f"WITH {masks} SELECT id, part, round(fill, 9) AS fill FROM mr",
        "join_suffix_coalesce": "SELECT o_orderkey AS id, o_custkey AS object, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END) AS route FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
        "manifest_context": f"WITH {report}, e AS (SELECT object AS id, round(avg(iou), 6) AS iou FROM r GROUP BY 1) SELECT id, iou, p_brand AS status, p_size AS size, p_name AS kind, p_type AS type FROM e LEFT JOIN part ON p_partkey = id AND p_partkey % 9 > 0",
        "last_duplicate_lookup": "WITH e AS (SELECT o_custkey AS key, max(o_orderkey) AS entry, arg_max(o_orderdate, o_orderkey) AS found FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_custkey END::BIGINT AS key, entry, strftime(found, '%Y-%m-%d') AS found FROM customer LEFT JOIN e ON key = CASE WHEN c_custkey % 7 > 0 THEN c_custkey END",
        "stem_join": "SELECT p_partkey || '.v1' AS stem, 'train' AS folder, 'masks/' || (s_suppkey * 3) || '.v1.png' AS mask FROM part JOIN supplier ON p_partkey = s_suppkey * 3",
        "path_resolution": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN '/data/chips/' || p_partkey || '.png' END AS path FROM part",
        "first_folder_lookup": "SELECT s_suppkey * 313 AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'tight/' ELSE 'wide/' END || printf('%04d', s_suppkey * 313) || '.png' AS path FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0",
        "dense_numbers": "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS subset_id FROM supplier WHERE s_acctbal > 5000",
        "ordinal_key": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders",
        "gap_keeping_ordinal": "SELECT id, p_partkey FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS id FROM part) WHERE p_size > 25",
        "final_geometry_choice": f"WITH {old}, {final}, o AS (SELECT id, {wkt} AS a FROM old), f AS (SELECT id, {wkt} AS b FROM final) SELECT id, CASE WHEN id % 4 IN (0, 2) THEN a ELSE b END AS wkt FROM o JOIN f USING (id)",
        "case_table": "SELECT p_partkey AS id, p_brand AS decision, CASE WHEN p_partkey % 2 = 1 THEN p_type ELSE '' END AS change, p_size AS measure FROM part WHERE p_partkey IN (3, 5, 8, 21, 34)",
        "checked_scan": f"WITH {old} SELECT id, CASE WHEN id % 5 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, x0 FROM old WHERE id % 5 > 0 AND id % 7 > 0",
        "date_slices": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders",
        "report_numbers": f"WITH {exp}, m AS (SELECT experiment, (sum(key) % 997)::DOUBLE / 8 AS m FROM e GROUP BY 1) SELECT experiment, printf('%.3f', m) || ' ' || printf('%+.3f', m - 50) || ' -' AS line FROM m",
        "fixed_category_counts": "SELECT count(*) FILTER (o_orderstatus = 'F') AS keep, count(*) FILTER (o_orderstatus = 'O') AS update, 0::BIGINT AS flag_review, 0 AS k FROM orders UNION ALL SELECT 0, 0, 0, 1 UNION ALL SELECT 0, 0, 0, 2",
        "conditional_empty": "SELECT p_partkey, p_brand FROM part WHERE false",
        "conditional_union": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#13', 'Brand#5')",
        "rounded_points": "WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS k, (max(l_partkey) % 40)::DOUBLE / 16 AS x, (max(l_suppkey) % 40)::DOUBLE / 16 AS y FROM lineitem GROUP BY 1) SELECT k, x, y FROM p QUALIFY row_number() OVER (PARTITION BY round(x, 1), round(y, 1) ORDER BY k) = 1",
        "prompt_labels": "SELECT p_partkey, repeat('1', (p_size % 4)::BIGINT) || repeat('0', (p_partkey % 3)::BIGINT) AS labels FROM part",
        "centre_spread": "WITH p AS (SELECT o_custkey AS id, (o_orderkey % 100)::DOUBLE AS x, (o_orderkey % 37)::DOUBLE AS y FROM orders), m AS (SELECT id, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY 1) SELECT id, round(CASE WHEN any_value(n) < 2 THEN 0 ELSE avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) END, 6) AS spread FROM p JOIN m USING (id) GROUP BY id",
    }
