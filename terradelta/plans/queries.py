"""One query for each operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import zero_padded
from ..operators import evaluation as ev
from ..operators import ranking, rules, sampling, spatial
from ..sources.tables import merging, parquet, written
from . import bindings as b
from . import measures, overlays, shapes, tables

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
CELL = 80.0


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    matched = spatial.best_overlap(b.old_footprints(spark, sf), b.new_footprints(spark, sf), g.box_iou("l_", "r_"), CELL)
    return matched.withColumn("best_iou", F.coalesce("best_score", F.lit(0.0))).withColumn("status", rules.snapshot_status(c("best_iou")))


def snapshot_diff_status(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("id", "status", "best_iou", "match_id", F.when(c("status") != "removed_candidate", c("match_id")).alias("kept_match_id"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).where("status <> 'removed_candidate'").select(c("match_id").alias("id")).distinct()


def snapshot_new_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return b.new_footprints(spark, sf).join(merging(_matches(spark, sf)), "id", "left_anti").select("id", "x0", "y0")


def matched_current_subset(spark: SparkSession, sf: str) -> DataFrame:
    return b.new_footprints(spark, sf).join(merging(_matches(spark, sf)), "id", "left_semi").select("id", "x0", "y0", "x1", "y1")


def status_union_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    old = _diff(spark, sf).select(F.lit("old").alias("source"), "id", "status", c("best_iou").alias("best_iou_to_new"))
    new = snapshot_new_candidates(spark, sf).select(F.lit("new").alias("source"), "id", F.lit("new_candidate").alias("status"), F.lit(0.0).alias("best_iou_to_old"))
    return old.unionByName(new, allowMissingColumns=True)


def external_eval_best_match(spark: SparkSession, sf: str) -> DataFrame:
    final, new = b.final_footprints(spark, sf), b.new_footprints(spark, sf)
    old = b.old_footprints(spark, sf).select("id", *(c(k).alias("o" + k) for k in spatial.BOUNDS))
    left = final.select("id", *(c(k).alias("f" + k) for k in spatial.BOUNDS)).join(merging(old), "id")
    wide = left.select("*", *(F.least("f" + k, "o" + k).alias(k) for k in ("x0", "y0")), *(F.greatest("f" + k, "o" + k).alias(k) for k in ("x1", "y1")))
    scored = spatial.overlapping(wide, new, CELL).select("l_id", "r_id", g.box_iou("l_f", "r_").alias("iou_final"), g.box_iou("l_o", "r_").alias("iou_orig"), g.centre_distance2("l_o", "r_").alias("tie"))
    plain = left.select("id", *(c("o" + k).alias(k) for k in spatial.BOUNDS))
    carried = {"iou_final": 0.0, "iou_orig": 0.0}
    found = spatial.matched_or_nearest(plain, scored.withColumn("score", F.greatest("iou_final", "iou_orig")), new, g.centre_distance2("l_", "r_") / 4, CELL, carried)  # half of the sides' sum: within the bounds
    return found.select("id", "match_id", *carried, (c("iou_final") - c("iou_orig")).alias("delta"), (c("iou_final") > c("iou_orig")).alias("improved"))


def removed_behavior(spark: SparkSession, sf: str) -> DataFrame:
    gone = _diff(spark, sf).where("status = 'removed_candidate'").select("id")
    final, new = written(b.final_footprints(spark, sf).join(merging(gone), "id", "left_semi")), b.new_footprints(spark, sf)
    scored = spatial.overlapping(final, new, CELL).select("l_id", "r_id", g.box_iou("l_", "r_").alias("score"), g.box_distance2("l_", "r_").alias("tie"))
    found = spatial.matched_or_nearest(final, scored, new, g.box_distance2("l_", "r_"), CELL)
    return found.select("id", "match_id", c("best_score").alias("max_iou"), rules.removed_behavior(c("best_score")).alias("behavior"))


def update_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = b.reports(spark, sf).withColumn("decision", rules.update_decision(c("pred"), c("iou"), c("area_diff"), c("shift")))
    return d.withColumn("final_source", rules.final_source(c("decision"))).groupBy("decision", "final_source", "part").agg(F.count("*").alias("n"), F.count_if("pred").alias("predicted"))


def keep_bias_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = b.reports(spark, sf).withColumn("decision", rules.keep_bias_decision(c("score"), c("iou"), c("area_diff"), c("shift")))
    return d.groupBy("decision", "kind").agg(F.count("*").alias("n"), F.min("score").alias("least_score"))


def status_eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = b.reports(spark, sf).withColumn("status", rules.snapshot_status(c("iou"))).withColumn("mode", rules.evaluation_mode(c("status"), c("pred")))
    d = d.withColumn("improved", F.when(c("mode") == "matched_reference", c("score") > c("iou")))
    return d.groupBy("status", "mode", "improved").agg(F.count("*").alias("n"), F.round(F.avg(F.when(c("mode") == "matched_reference", c("iou"))), 6).alias("mean_iou"))


def new_building_detection(spark: SparkSession, sf: str) -> DataFrame:
    return b.reports(spark, sf).groupBy(rules.detection(c("iou")).alias("detection")).agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"))


def _uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """From every pair of an object's experiments, and the spread of its values. An object has a row for each of a few experiments, so these fit into one list."""
    e = b.experiments(spark, sf).groupBy("id", "step").agg(F.min_by("value", "key").alias("value"), F.min_by("decision", "key").alias("decision"))
    cv = F.when((F.count("*") < 2) | (F.avg("value") <= 0), 0.0).otherwise(F.stddev_pop("value") / F.avg("value"))
    own = e.groupBy("id").agg(F.round(cv, 9).alias("area_cv"), (F.count_distinct("decision") > 1).alias("disagreement"), F.avg("value").alias("centre"), F.array_sort(F.collect_list("value")).alias("values"))
    likeness = lambda x, y: F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(0.0))
    later = lambda i: F.slice("values", i + 2, F.size("values"))
    pairs = F.flatten(F.transform("values", lambda x, i: F.transform(later(i), lambda y: likeness(x, y))))
    mean = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))
    u = own.withColumns({"pairwise": F.coalesce(F.round(mean(pairs), 9), F.lit(0.0)), "spread": F.round(mean(F.transform("values", lambda v: F.abs(v - c("centre")))) / 50, 9)})
    u = u.withColumn("points", rules.uncertainty_points(c("pairwise"), c("area_cv"), c("spread"), c("disagreement")))
    return u.withColumn("level", rules.uncertainty_level(c("points")))


def uncertainty_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _uncertainty(spark, sf).select("id", "disagreement", "points", "level", F.round("pairwise", 6).alias("pairwise"), F.round("area_cv", 6).alias("area_cv"), F.round("spread", 6).alias("spread"))


def _taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled objects (customers), some without a label."""
    return parquet(spark, sf, "customer").select(c("c_custkey").alias("id"), b.named(c("c_custkey") % 11, b.KINDS).alias("primary"), F.when(c("c_custkey") % 5 > 0, F.concat(F.lit("exp0"), c("c_custkey") % 5)).alias("best"))


def routing_table(spark: SparkSession, sf: str) -> DataFrame:
    t = _taxonomy(spark, sf).join(_uncertainty(spark, sf), "id", "left")
    return t.select("id", "primary", "level", rules.routing_decision(c("primary"), c("level"), c("disagreement")).alias("route"), F.coalesce("best", F.lit("exp04")).alias("pass1_source"))


def suggested_refinement(spark: SparkSession, sf: str) -> DataFrame:
    t = _uncertainty(spark, sf).join(_taxonomy(spark, sf), "id", "left")
    return t.select("id", rules.suggested_refinement(c("level"), c("primary")).alias("refinement"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    level, kind = b.named(c("grade"), b.LEVELS), b.named(c("kind"), b.KINDS)
    hidden = c("part") == 7  # without an image
    return b.reports(spark, sf).select("id", "part", F.when(~hidden, c("shift") / 10).alias("dark"), F.when(~hidden, c("iou") * 25).alias("drop"), (c("iou") * 30).alias("inside_std"), ((c("area_diff") + 0.4) / 5).alias("hull"), (c("score") - 0.1).alias("compact"), F.when(c("kind") > 2, c("shift") / 25).alias("edges"), level.alias("level"), kind.alias("primary"))


def auto_routes_v1(spark: SparkSession, sf: str) -> DataFrame:
    route = rules.auto_route_v1(c("dark"), c("drop"), c("hull"), c("compact"), c("edges"), c("level"), c("primary"))
    return _features(spark, sf).groupBy(route.alias("route"), "level").agg(F.count("*").alias("n"))


def auto_routes_v2(spark: SparkSession, sf: str) -> DataFrame:
    route = rules.auto_route_v2(c("dark"), c("drop"), c("inside_std"), c("hull"), c("compact"), c("edges"), c("level"))
    return _features(spark, sf).groupBy(route.alias("route"), "level").agg(F.count("*").alias("n"))


def selective_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """The pass that an object names as its source is the one of that experiment: a join on (id, experiment)."""
    e = b.experiments(spark, sf).groupBy("id", "step").agg(F.min_by("value", "key").alias("value"), F.min_by("decision", "key").alias("decision"))
    objects = _taxonomy(spark, sf).withColumn("source", c("id") % 4)
    first = objects.join(e.select("id", c("step").alias("source"), (c("value") / 600).alias("old_iou")), ["id", "source"])
    second = e.where("step = 4").select("id", (c("value") / 600).alias("iou"), F.when(c("decision") == "P", "flag_review").otherwise("update").alias("decision"))
    j = first.join(second, "id")
    route = F.when(c("primary").isin(*rules.TOPOLOGY), "topology_refine").otherwise("no_refine")
    accepted, reason = rules.selective_acceptance(route, (c("id") % 100) / 100, c("decision"), c("iou"), (c("id") % 9) / 10, c("old_iou"), (c("id") % 7) / 10)
    return j.select("id", accepted.alias("accepted"), reason.alias("reason"), F.when(accepted, "pass2_topology").otherwise(F.concat(F.lit("pass1_"), c("source"))).alias("selected_source"))


def shadow_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    r = b.reports(spark, sf)
    ratio = F.when(c("pred"), c("iou") * 100 / F.greatest(c("score") * 100, F.lit(1e-9)))
    return r.groupBy(rules.shadow_acceptance(c("score"), c("iou"), c("shift"), ratio).alias("accepted"), "part").agg(F.count("*").alias("n"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when(c("flag") == "A", "keep").when(c("flag") == "N", "update").when(c("part") < 4, "flag_review").otherwise("flag_no_prediction")
    route = F.when(c("kind") == 1, "shadow_refine").when(c("kind").between(2, 4), "topology_refine")
    level = F.when(c("grade") > 0, b.named(c("grade") - 1, b.LEVELS))
    kind = rules.change_type(decision, c("score"), c("iou"), c("area_diff"), c("shift"), route, level, c("kind") == 9)
    return b.reports(spark, sf).withColumn("change", kind).select("id", "part", c("change.type").alias("predicted"), c("change.reason").alias("reason"), rules.reference_change_type(F.when(c("pred"), c("score"))).alias("reference"))


def change_types(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).groupBy("predicted", "reason", "reference", (c("predicted") == c("reference")).alias("matches")).agg(F.count("*").alias("n"))


def change_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ev.crosstab(_changes(spark, sf), "reference", "predicted", ["unchanged", "modified"], ["unchanged", "modified", "review"])


def change_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = _changes(spark, sf)
    out = ev.binary_measures(d, c("predicted").isin("modified", "review"), c("reference") == "modified")
    exact = d.agg(F.avg((c("predicted") == c("reference")).cast("int")).alias("exact"))
    return out.crossJoin(exact).select("tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1", "exact")))  # one row and one row


def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = b.experiments(spark, sf)
    count = lambda s: F.count_if(c("decision") == s)
    rows = e.groupBy("step", "experiment").agg(F.count("*").alias("n_objects"), F.round(F.avg("value"), 6).alias("mean_value"), count("O").alias("keep"), count("F").alias("update"), count("P").alias("review"), F.count_if(c("value") > 250).alias("improved"))
    out = ev.step_differences(rows, "step", "mean_value")
    return out.withColumns({"delta_previous": F.round("delta_previous", 6), "delta_first": F.round("delta_first", 6)})


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    e = b.experiments(spark, sf).groupBy("id", "step").agg(F.max("value").alias("value"))
    one = e.where("step = 0").select("id", c("value").alias("first_value"))
    return one.join(e.where("step = 1").select("id", c("value").alias("second_value")), "id").withColumn("gain", F.round(c("second_value") - c("first_value"), 6))


def experiment_compare_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ev.top(_compared(spark, sf), c("gain").desc(), "id", 10)


def experiment_compare_bottomk(spark: SparkSession, sf: str) -> DataFrame:
    return ev.top(_compared(spark, sf), c("gain").asc(), "id", 10)


def experiment_describe(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.describe(b.experiments(spark, sf), ["experiment"], "value")
    return out.select("experiment", "n", *(F.round(x, 9).alias(x) for x in ("mean", "std", "least", "q25", "q50", "q75", "most")))  # quartiles end with the seventh decimal


def outer_three_way(spark: SparkSession, sf: str) -> DataFrame:
    e = b.experiments(spark, sf).where("decision = 'P'").groupBy("id", "step").agg(F.max("value").alias("value"))
    of = lambda k: e.where(c("step") == k).select("id", c("value").alias(f"value_{k}"))
    return of(0).join(of(1), "id", "outer").join(of(2), "id", "outer")


def stratified_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas are part of the operator."""
    return sampling.stratified(_diff(spark, sf), "status", "id", {"unchanged_candidate": 15, "changed_candidate": 40}).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def area_filter(spark: SparkSession, sf: str) -> DataFrame:
    size = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    return b.old_footprints(spark, sf).withColumn("size", size).where(c("size").between(150, 400)).select("id", "size")


def chip_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows inside the raster, which ends with the map: touching its edge is inside."""
    w = b.new_footprints(spark, sf).withColumn("w", g.chip_window(c("x0"), c("y0"), c("x1"), c("y1"))).select("id", "w.*")
    kept = w.where("left >= -20 and bottom >= -20 and right <= 2000 and top <= 1000000")
    return kept.select("id", *(F.round(k, 6).alias(k) for k in ("left", "bottom", "right", "top")))


def bbox_expand(spark: SparkSession, sf: str) -> DataFrame:
    grow = lambda k, d: F.least(F.greatest(c(k) + d, F.lit(0)), F.lit(2000))
    return b.new_footprints(spark, sf).select("id", grow("x0", -24).alias("x0"), grow("y0", -24).alias("y0"), grow("x1", 24).alias("x1"), grow("y1", 24).alias("y1"))


def footprint_shape_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = b.old_footprints(spark, sf).withColumn("geometry", g.parse_wkt(g.box_wkt(c("x0"), c("y0"), c("x1"), c("y1"))))
    p = p.select("id", g.area(c("geometry")).alias("size"), g.perimeter(c("geometry")).alias("length"), g.centroid(c("geometry")).alias("m"), g.bounds(c("geometry")).alias("bb"), g.holes(c("geometry")).alias("holes"), g.hull_area(c("geometry")).alias("hull"))
    sides = F.struct((c("bb.x1") - c("bb.x0")).alias("w"), (c("bb.y1") - c("bb.y0")).alias("h"))
    return p.withColumn("s", sides).select("id", "size", "length", c("m.x").alias("cx"), c("m.y").alias("cy"), "holes", F.round(g.compactness(c("size"), c("length")), 9).alias("compact"), F.round(spatial.hull_gap_frac(c("size"), c("hull")), 9).alias("hull_gap"), F.round(F.greatest("s.w", "s.h") / F.least("s.w", "s.h"), 9).alias("elongation"))


def polygon_iou_general(spark: SparkSession, sf: str) -> DataFrame:
    def shaped(df: DataFrame) -> DataFrame:
        whole = df.withColumn("geometry", g.parse_wkt(g.box_wkt(c("x0"), c("y0"), c("x1"), c("y1"))))
        return whole.select("id", *spatial.BOUNDS, g.edges(c("geometry")).alias("edges"), g.area(c("geometry")).alias("size"))

    pairs = spatial.overlapping(shaped(b.old_footprints(spark, sf)), shaped(b.new_footprints(spark, sf)), CELL)
    pairs = pairs.withColumn("common", g.common_area(c("l_edges"), c("r_edges")))
    return pairs.select(c("l_id").alias("id"), c("r_id").alias("other"), F.round(F.try_divide(c("common"), c("l_size") + c("r_size") - c("common")), 9).alias("iou"))


def rerank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Several candidate masks (order lines) of each object (order)."""
    d = b.reports(spark, sf).groupBy("id", "part").agg(F.max(F.struct("object", "score", "iou", "area_diff", "shift", "kind")).alias("r")).select("id", "part", "r.*")
    d = d.select("id", "part", (c("object") % 97 / 100).alias("sam_score"), ranking.area_consistency(1 + c("area_diff"), F.lit(1.0)).alias("area_consistency"), c("iou").alias("bbox_iou_hist"), ranking.centroid_consistency(c("shift"), F.lit(20.0)).alias("centroid_consistency"), (c("iou") / 2).alias("hist_mask_iou"), (c("kind") > 0).alias("usable"))
    best = ranking.best_candidate(d, "id", "part", F.round(ranking.weighted(ranking.CHANGED), 9), c("usable"), F.round("sam_score", 9))
    return best.select("id", "part", "combined", "reranked")


def segmentation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    counts = b.reports(spark, sf).groupBy("object").agg(F.count_if((c("iou") > 0.5) & (c("score") > 0.7)).cast("double").alias("tp"), F.count_if((c("iou") > 0.5) & (c("score") <= 0.7)).cast("double").alias("fp"), F.count_if((c("iou") <= 0.5) & (c("score") > 0.7)).cast("double").alias("fn"))
    return counts.select("object", *(F.round(v, 9).alias(k) for k, v in ev.segmentation_measures(c("tp"), c("fp"), c("fn")).items()))


def layer_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Layers (parts) by what their names promise; the best ten."""
    blob = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    score = F.when(blob.contains("red"), 3).otherwise(0) + F.when(blob.contains("eco") | blob.contains("ring"), 2).otherwise(0) + F.when(blob.contains("widget"), 1).otherwise(0)
    return parquet(spark, sf, "part").select("p_partkey", score.alias("score")).orderBy(c("score").desc(), c("p_partkey").desc()).limit(10)


def json_points(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))
    text = F.when(c("k") % 3 > 0, F.concat(F.lit("[["), c("k"), F.lit(","), c("k") + 1, F.lit("],[0,1]]")))
    points = F.coalesce(F.from_json(text, "array<array<double>>"), F.array().cast("array<array<double>>"))
    return d.select("event_id", F.size(points).cast("long").alias("n"), F.aggregate(points, F.lit(0.0), lambda s, p: s + p[0] * p[1]).alias("total"))


def value_counts_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return ev.value_counts(_taxonomy(spark, sf), "best")


def affine_pixels(spark: SparkSession, sf: str) -> DataFrame:
    px = g.world_to_pixel(c("x0"), c("y1"), F.lit(0.0), F.lit(0.0), F.lit(2048.0), F.lit(4096.0), 512, 1024)
    return b.old_footprints(spark, sf).withColumn("p", px).select("id", F.floor("p.x").alias("px"), F.ceil("p.y").alias("py"))


def union_bounds(spark: SparkSession, sf: str) -> DataFrame:
    u = b.old_footprints(spark, sf).select("x0", "y0", "x1", "y1").unionByName(b.new_footprints(spark, sf).select("x0", "y0", "x1", "y1"))
    return u.agg((F.min("x0") - 5).alias("x0"), (F.min("y0") - 5).alias("y0"), (F.max("x1") + 5).alias("x1"), (F.max("y1") + 5).alias("y1"))


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = b.experiments(spark, sf).groupBy("experiment").agg(F.round(F.avg("value"), 3).alias("m"), F.count_if(c("decision") == "O").alias("o"), F.count_if(c("decision") == "F").alias("f"))
    return e.select("experiment", F.concat_ws(" & ", F.replace("experiment", F.lit("-"), F.lit(r"\_")), F.concat_ws("/", "o", "f"), zero_padded(c("o"), 6)).alias("line"))


def queries() -> dict[str, Query]:
    names = (
        snapshot_diff_status, snapshot_new_candidates, matched_current_subset, status_union_missing_cols, external_eval_best_match, removed_behavior, update_decision, keep_bias_decision,
        status_eval_summary, new_building_detection, uncertainty_levels, routing_table, suggested_refinement, auto_routes_v1, auto_routes_v2, selective_acceptance, shadow_acceptance,
        change_types, change_confusion, change_metrics, ablation_summary, experiment_compare_topk, experiment_compare_bottomk, experiment_describe, outer_three_way, stratified_sample_counts,
        area_filter, chip_windows, bbox_expand, footprint_shape_metrics, polygon_iou_general, rerank_candidates, segmentation_metrics, layer_pick, json_points, value_counts_nulls,
        affine_pixels, union_bounds, report_lines,
    )
    return {f.__name__: f for f in (*names, *shapes.QUERIES, *overlays.QUERIES, *measures.QUERIES, *tables.QUERIES)}
