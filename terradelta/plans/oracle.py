"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

from . import measures, overlays, shapes, tables

OLD = """old AS (SELECT p_partkey AS id, (p_partkey % 50 * 40)::BIGINT AS x0, (p_partkey // 50 * 40)::BIGINT AS y0, (p_partkey % 50 * 40 + 10 + p_size % 15)::BIGINT AS x1, (p_partkey // 50 * 40 + 10 + p_partkey % 13)::BIGINT AS y1 FROM part)"""
NEW = """new AS (SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
  SELECT p_partkey AS id, (p_partkey % 50 * 40 + CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 5 ELSE 0 END)::BIGINT AS x0, (p_partkey // 50 * 40 + CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 ELSE 0 END)::BIGINT AS y0,
    (CASE WHEN p_partkey % 29 = 0 THEN 70 ELSE 10 + p_size % 15 + CASE WHEN p_partkey % 7 = 0 THEN 6 ELSE 0 END END)::BIGINT AS w, (10 + p_partkey % 13)::BIGINT AS h FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT s_suppkey + 1000000000, s_suppkey * 40 + 100000, 0, 20, 20 FROM supplier))"""
FINAL = """final AS (SELECT p_partkey AS id, (p_partkey % 50 * 40 + p_size % 4)::BIGINT AS x0, (p_partkey // 50 * 40)::BIGINT AS y0, (p_partkey % 50 * 40 + p_size % 4 + 10 + p_size % 15 + p_partkey % 3)::BIGINT AS x1, (p_partkey // 50 * 40 + 10 + p_partkey % 13)::BIGINT AS y1 FROM part)"""


def _common(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def _iou(a: str, b: str) -> str:
    size = lambda p: f"({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0)"
    return f"({_common(a, b)}::DOUBLE / ({size(a)} + {size(b)} - {_common(a, b)})::DOUBLE)"


def _meet(a: str, b: str) -> str:
    return f"{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


DIFF = f"""{OLD}, {NEW}, best AS (
  SELECT o.id, n.id AS match_id, {_iou("o", "n")} AS iou FROM old o JOIN new n ON {_meet("o", "n")}
  QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY {_iou("o", "n")} DESC, n.id) = 1),
diff AS (SELECT id, match_id, coalesce(iou, 0.0) AS best_iou,
  CASE WHEN coalesce(iou, 0) < 0.1 THEN 'removed_candidate' WHEN iou >= 0.85 THEN 'unchanged_candidate' ELSE 'changed_candidate' END AS status FROM old LEFT JOIN best USING (id)),
hit AS (SELECT DISTINCT match_id AS id FROM diff WHERE status <> 'removed_candidate')"""

REPORT = """r AS (SELECT l_orderkey AS id, l_linenumber AS part, l_linenumber % 7 <> 0 AS pred, l_quantity / 50 AS iou, l_tax * 10 - 0.4::DOUBLE AS area_diff, l_discount * 50 AS shift,
  (l_orderkey % 51 + 50)::DOUBLE / 100 AS score, l_returnflag AS flag, l_partkey % 10 AS kind, l_suppkey % 3 AS grade, l_partkey AS object FROM lineitem)"""
KINDS = "['stable_case', 'shadow_roof', 'courtyard_structure', 'multi_level_roof', 'multi_part_roof', 'neighbor_merge', 'wrong_building_focus', 'oversegmentation', 'polygon_geometry', 'unknown']"
LEVELS = "['low', 'medium', 'high']"
EXP = "e AS (SELECT o_custkey AS id, o_orderpriority AS experiment, substr(o_orderpriority, 1, 1)::INT - 1 AS step, o_totalprice / 1000 AS value, o_orderstatus AS decision, o_orderkey AS key FROM orders)"
FIRST = f"{EXP}, f AS (SELECT id, step, arg_min(value, key) AS value, arg_min(decision, key) AS decision FROM e GROUP BY id, step)"
TAX = f"t AS (SELECT c_custkey AS id, {KINDS}[c_custkey % 11 + 1] AS \"primary\", CASE WHEN c_custkey % 5 > 0 THEN 'exp0' || (c_custkey % 5) END AS best FROM customer)"
UNCERTAIN = f"""{FIRST}, own AS (
  SELECT id, round(CASE WHEN count(*) < 2 OR avg(value) <= 0 THEN 0 ELSE stddev_pop(value) / avg(value) END, 9) AS area_cv, count(DISTINCT decision) > 1 AS disagreement, avg(value) AS centre FROM f GROUP BY id),
spread AS (SELECT id, round(avg(abs(value - centre)) / 50, 9) AS spread FROM f JOIN own USING (id) GROUP BY id),
pairs AS (SELECT a.id, round(avg(least(a.value, b.value) / greatest(a.value, b.value)), 9) AS pairwise FROM f a JOIN f b ON a.id = b.id AND a.step < b.step GROUP BY a.id),
p AS (SELECT id, disagreement, area_cv, spread, coalesce(pairwise, 0) AS pairwise FROM own JOIN spread USING (id) LEFT JOIN pairs USING (id)),
u AS (SELECT *, (CASE WHEN pairwise < 0.55 THEN 2 WHEN pairwise < 0.75 THEN 1 ELSE 0 END + CASE WHEN area_cv > 0.3 THEN 2 WHEN area_cv > 0.15 THEN 1 ELSE 0 END
  + CASE WHEN spread > 3 THEN 2 WHEN spread > 1.5 THEN 1 ELSE 0 END + CASE WHEN disagreement THEN 1 ELSE 0 END)::INT AS points FROM p),
v AS (SELECT *, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM u)"""
REFINE = """WHEN "primary" = 'shadow_roof' THEN 'shadow_refine' WHEN "primary" IN ('courtyard_structure', 'multi_level_roof', 'multi_part_roof') THEN 'topology_refine'
  WHEN "primary" IN ('neighbor_merge', 'wrong_building_focus') THEN 'context_refine' WHEN "primary" IN ('oversegmentation', 'undersegmentation', 'polygon_geometry') THEN 'geometry_refine' ELSE 'manual_review' END"""
FEATURES = f"""{REPORT}, x AS (SELECT CASE WHEN part <> 7 THEN shift / 10 END AS dark, CASE WHEN part <> 7 THEN iou * 25 END AS drp, iou * 30 AS inside_std, (area_diff + 0.4::DOUBLE) / 5 AS hull, score - 0.1::DOUBLE AS compact,
  CASE WHEN kind > 2 THEN shift / 25 END AS edges, {LEVELS}[grade + 1] AS level, {KINDS}[kind + 1] AS "primary" FROM r)"""
CHANGES = f"""{REPORT}, s AS (SELECT *, CASE WHEN flag = 'A' THEN 'keep' WHEN flag = 'N' THEN 'update' WHEN part < 4 THEN 'flag_review' ELSE 'flag_no_prediction' END AS decision, abs(area_diff) AS a,
    CASE WHEN kind = 1 THEN 'shadow_refine' WHEN kind BETWEEN 2 AND 4 THEN 'topology_refine' END AS route, CASE WHEN grade > 0 THEN {LEVELS}[grade] END AS level FROM r),
w AS (SELECT *, CASE WHEN decision = 'flag_review' THEN 'review:flag_review_from_update_layer'
    WHEN decision = 'keep' AND iou >= 0.8 AND a <= 0.18 AND shift <= 1.5 THEN 'unchanged:stable_keep_geometry' WHEN decision = 'keep' THEN 'review:keep_but_not_geometrically_stable'
    WHEN decision = 'update' AND iou <= 0.18 AND score <= 0.55 THEN 'removed_candidate:weak_current_object_evidence'
    WHEN decision = 'update' AND score >= 0.82 AND iou >= 0.5 AND a <= 0.6 AND shift <= 10 THEN 'modified:strong_update_evidence'
    WHEN decision = 'update' AND kind = 9 AND score >= 0.75 AND iou >= 0.45 THEN 'modified:accepted_specialized_refinement'
    WHEN decision = 'update' AND (coalesce(level IN ('medium', 'high'), false) OR coalesce(route IN ('shadow_refine', 'topology_refine', 'context_refine'), false)) THEN 'review:update_but_mixed_evidence'
    WHEN decision = 'update' THEN 'modified:default_update_case' ELSE 'review:fallback' END AS change FROM s),
c AS (SELECT split_part(change, ':', 1) AS predicted, split_part(change, ':', 2) AS reason, CASE WHEN pred AND score >= 0.9 THEN 'unchanged' ELSE 'modified' END AS reference FROM w)"""
COMPARED = f"""{EXP}, m AS (SELECT id, step, max(value) AS value FROM e GROUP BY id, step),
g AS (SELECT a.id, a.value AS first_value, b.value AS second_value, round(b.value - a.value, 6) AS gain FROM m a JOIN m b ON a.id = b.id AND a.step = 0 AND b.step = 1)"""


def oracle_sql() -> dict[str, str]:
    centre = "((o.x0 + o.x1 - n.x0 - n.x1) * (o.x0 + o.x1 - n.x0 - n.x1) + (o.y0 + o.y1 - n.y0 - n.y1) * (o.y0 + o.y1 - n.y0 - n.y1))"
    gap = lambda k: f"greatest(0, n.{k}0 - f.{k}1, f.{k}0 - n.{k}1)"
    score = f"greatest({_iou('f', 'n')}, {_iou('o', 'n')})"
    grow = lambda k, d: f"least(greatest({k} + {d}, 0), 2000) AS {k}"
    count = lambda v: f"count(*) FILTER (decision = '{v}')"
    return shapes.oracle_sql(OLD, NEW, FINAL) | overlays.oracle_sql(OLD, NEW, FINAL, shapes.boxes) | measures.oracle_sql(OLD, NEW, FINAL, REPORT, shapes.boxes) | tables.oracle_sql(OLD, FINAL, REPORT, EXP) | {
        "snapshot_diff_status": f"WITH {DIFF} SELECT id, status, best_iou, match_id, CASE WHEN status <> 'removed_candidate' THEN match_id END AS kept_match_id FROM diff",
        "snapshot_new_candidates": f"WITH {DIFF} SELECT id, x0, y0 FROM new WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = new.id)",
        "matched_current_subset": f"WITH {DIFF} SELECT id, x0, y0, x1, y1 FROM new WHERE id IN (SELECT id FROM hit)",
        "status_union_missing_cols": f"WITH {DIFF} SELECT 'old' AS source, id, status, best_iou AS best_iou_to_new, NULL::DOUBLE AS best_iou_to_old FROM diff UNION ALL SELECT 'new', id, 'new_candidate', NULL, 0.0 FROM new WHERE id NOT IN (SELECT id FROM hit)",
        "external_eval_best_match": f"""WITH {OLD}, {NEW}, {FINAL} SELECT f.id, n.id AS match_id, {_iou("f", "n")} AS iou_final, {_iou("o", "n")} AS iou_orig, {_iou("f", "n")} - {_iou("o", "n")} AS delta, {_iou("f", "n")} > {_iou("o", "n")} AS improved
          FROM final f JOIN old o USING (id), new n QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY {score} DESC, {centre}, n.id) = 1""",
        "removed_behavior": f"""WITH {DIFF}, {FINAL} SELECT f.id, n.id AS match_id, {_iou("f", "n")} AS max_iou, CASE WHEN {_iou("f", "n")} < 0.1 THEN 'still_removed_like' WHEN {_iou("f", "n")} < 0.25 THEN 'weak_overlap_with_current' ELSE 'snapped_to_current_building' END AS behavior
          FROM final f JOIN diff ON diff.id = f.id AND status = 'removed_candidate', new n QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY {_iou("f", "n")} DESC, {gap("x")} * {gap("x")} + {gap("y")} * {gap("y")}, n.id) = 1""",
        "update_decision": f"""WITH {REPORT}, d AS (SELECT *, CASE WHEN NOT pred THEN 'flag_no_prediction' WHEN iou >= 0.85 AND abs(area_diff) <= 0.15 AND shift <= 2 THEN 'keep' WHEN iou >= 0.25 THEN 'update' ELSE 'flag_review' END AS decision FROM r)
          SELECT decision, CASE decision WHEN 'update' THEN 'sam2' WHEN 'flag_review' THEN 'osm_review' ELSE 'osm' END AS final_source, part, count(*) AS n, count(*) FILTER (pred) AS predicted FROM d GROUP BY ALL""",
        "keep_bias_decision": f"""WITH {REPORT}, d AS (SELECT *, CASE WHEN iou >= 0.7 AND abs(area_diff) <= 0.15 AND shift <= 1.5 THEN 'keep' WHEN score >= 0.94 AND iou <= 0.5 AND abs(area_diff) >= 0.22 AND shift >= 2 THEN 'update'
            WHEN score >= 0.85 AND (iou <= 0.62 OR abs(area_diff) >= 0.16 OR shift >= 1.2) THEN 'flag_review' ELSE 'keep' END AS decision FROM r) SELECT decision, kind, count(*) AS n, min(score) AS least_score FROM d GROUP BY ALL""",
        "status_eval_summary": f"""WITH {REPORT}, d AS (SELECT *, CASE WHEN iou < 0.1 THEN 'removed_candidate' WHEN iou >= 0.85 THEN 'unchanged_candidate' ELSE 'changed_candidate' END AS status FROM r),
          m AS (SELECT *, CASE WHEN status <> 'removed_candidate' AND pred THEN 'matched_reference' WHEN status = 'removed_candidate' THEN 'removed_against_any_current' ELSE 'unmatched' END AS mode FROM d)
          SELECT status, mode, CASE WHEN mode = 'matched_reference' THEN score > iou END AS improved, count(*) AS n, round(avg(CASE WHEN mode = 'matched_reference' THEN iou END), 6) AS mean_iou FROM m GROUP BY ALL""",
        "new_building_detection": f"WITH {REPORT} SELECT CASE WHEN iou >= 0.6 THEN 'good_detection' WHEN iou >= 0.3 THEN 'partial_detection' ELSE 'missed_detection' END AS detection, count(*) AS n, round(avg(iou), 6) AS mean_iou FROM r GROUP BY 1",
        "uncertainty_levels": f"WITH {UNCERTAIN} SELECT id, disagreement, points, level, round(pairwise, 6) AS pairwise, round(area_cv, 6) AS area_cv, round(spread, 6) AS spread FROM v",
        "routing_table": f"""WITH {UNCERTAIN}, {TAX} SELECT id, "primary", level, CASE WHEN "primary" = 'stable_case' AND (coalesce(disagreement, false) OR coalesce(level = 'medium', false)) THEN 'review_keep' WHEN "primary" = 'stable_case' THEN 'no_refine' {REFINE} AS route, coalesce(best, 'exp04') AS pass1_source FROM t LEFT JOIN v USING (id)""",
        "suggested_refinement": f"""WITH {UNCERTAIN}, {TAX} SELECT id, CASE WHEN level = 'low' OR "primary" = 'stable_case' THEN 'no_refine' {REFINE} AS refinement FROM v LEFT JOIN t USING (id)""",
        "auto_routes_v1": f"""WITH {FEATURES} SELECT CASE WHEN dark >= 0.22 AND drp >= 18 THEN 'shadow_refine' WHEN hull >= 0.08 OR compact <= 0.45 OR coalesce(edges >= 0.1, false) THEN 'topology_refine' WHEN level = 'medium' AND "primary" = 'stable_case' THEN 'review_keep' ELSE 'no_refine' END AS route, level, count(*) AS n FROM x GROUP BY ALL""",
        "auto_routes_v2": f"""WITH {FEATURES} SELECT CASE WHEN (dark >= 0.18 AND drp >= 14) OR (inside_std >= 20 AND drp >= 10) THEN 'shadow_refine' WHEN hull >= 0.08 OR compact <= 0.45 OR coalesce(edges >= 0.16 AND level IN ('medium', 'high'), false) THEN 'topology_refine' WHEN level = 'medium' THEN 'review_keep' ELSE 'no_refine' END AS route, level, count(*) AS n FROM x GROUP BY ALL""",
        "selective_acceptance": f"""WITH {FIRST}, {TAX}, j AS (SELECT t.id, t.id % 4 AS source, a.value / 600 AS old_iou, b.value / 600 AS iou, b.decision = 'P' AS flagged, "primary" IN ('courtyard_structure', 'multi_level_roof', 'multi_part_roof') AS route
            FROM t JOIN f a ON a.id = t.id AND a.step = t.id % 4 JOIN f b ON b.id = t.id AND b.step = 4),
          k AS (SELECT *, (id % 100)::DOUBLE / 100 >= 0.72 AS c1, iou >= old_iou - 0.05::DOUBLE AS c2, (id % 9)::DOUBLE / 10 <= (id % 7)::DOUBLE / 10 + 0.1::DOUBLE AS c3, NOT flagged AS c4 FROM j),
          l AS (SELECT *, coalesce(route, false) AND c1 AND c2 AND c3 AND c4 AS accepted FROM k)
          SELECT id, accepted, CASE WHEN route THEN 'score=' || CASE WHEN c1 THEN 'True' ELSE 'False' END || ';iou_drop=' || CASE WHEN c2 THEN 'True' ELSE 'False' END || ';area=' || CASE WHEN c3 THEN 'True' ELSE 'False' END || ';review=' || CASE WHEN c4 THEN 'True' ELSE 'False' END ELSE 'not_applicable' END AS reason,
            CASE WHEN accepted THEN 'pass2_topology' ELSE 'pass1_' || source END AS selected_source FROM l""",
        "shadow_acceptance": f"""WITH {REPORT}, q AS (SELECT *, CASE WHEN pred THEN iou * 100 / greatest(score * 100, 1e-9) END AS ratio FROM r) SELECT coalesce(score >= 0.78 AND iou >= 0.55 AND shift <= 2.5 AND ratio >= 0.9 AND ratio <= 1.3, false) AS accepted, part, count(*) AS n FROM q GROUP BY ALL""",
        "change_types": f"WITH {CHANGES} SELECT predicted, reason, reference, predicted = reference AS matches, count(*) AS n FROM c GROUP BY ALL",
        "change_confusion": f"WITH {CHANGES} SELECT l.reference, count(*) FILTER (predicted = 'unchanged') AS unchanged, count(*) FILTER (predicted = 'modified') AS modified, count(*) FILTER (predicted = 'review') AS review FROM (VALUES ('unchanged'), ('modified')) l(reference) LEFT JOIN c USING (reference) GROUP BY 1",
        "change_metrics": f"""WITH {CHANGES}, b AS (SELECT predicted IN ('modified', 'review') AS p, reference = 'modified' AS a, predicted = reference AS ok FROM c),
          n AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn, avg(ok::INT) AS exact FROM b),
          z AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS pr, tp / nullif(tp + fn, 0)::DOUBLE AS re FROM n)
          SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 9) AS accuracy, round(pr, 9) AS precision, round(re, 9) AS recall, round(2 * pr * re / nullif(pr + re, 0), 9) AS f1, round(exact, 9) AS exact FROM z""",
        "ablation_summary": f"""WITH {EXP}, a AS (SELECT step, experiment, count(*) AS n_objects, round(avg(value), 6) AS mean_value, {count("O")} AS keep, {count("F")} AS update, {count("P")} AS review, count(*) FILTER (value > 250) AS improved FROM e GROUP BY ALL)
          SELECT *, round(coalesce(mean_value - lag(mean_value) OVER (ORDER BY step), 0), 6) AS delta_previous, round(mean_value - first_value(mean_value) OVER (ORDER BY step), 6) AS delta_first FROM a""",
        "experiment_compare_topk": f"WITH {COMPARED} SELECT * FROM g ORDER BY gain DESC, id LIMIT 10",
        "experiment_compare_bottomk": f"WITH {COMPARED} SELECT * FROM g ORDER BY gain, id LIMIT 10",
        "experiment_describe": f"WITH {EXP} SELECT experiment, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(min(value), 9) AS least, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75, round(max(value), 9) AS most FROM e GROUP BY 1",
        "outer_three_way": f"WITH {EXP}, m AS (SELECT id, step, max(value) AS value FROM e WHERE decision = 'P' GROUP BY ALL) SELECT id, max(value) FILTER (step = 0) AS value_0, max(value) FILTER (step = 1) AS value_1, max(value) FILTER (step = 2) AS value_2 FROM m WHERE step < 3 GROUP BY id",
        "stratified_sample_counts": f"WITH {DIFF}, n AS (SELECT status, count(*) AS n FROM diff GROUP BY 1), k AS (SELECT status, CASE status WHEN 'unchanged_candidate' THEN least(n, 15) WHEN 'changed_candidate' THEN least(n, 40) ELSE n END AS n FROM n) SELECT status, n, n AS ids FROM k",
        "area_filter": f"WITH {OLD} SELECT id, (x1 - x0) * (y1 - y0) AS size FROM old WHERE (x1 - x0) * (y1 - y0) BETWEEN 150 AND 400",
        "chip_windows": f"""WITH {NEW}, s AS (SELECT id, (x0 + x1)::DOUBLE / 2 AS cx, (y0 + y1)::DOUBLE / 2 AS cy, least(greatest(greatest(x1 - x0, y1 - y0) * 1.35::DOUBLE + 12, 35), 110) / 2 AS half FROM new)
          SELECT id, round(cx - half, 6) AS "left", round(cy - half, 6) AS bottom, round(cx + half, 6) AS "right", round(cy + half, 6) AS top FROM s WHERE cx - half >= -20 AND cy - half >= -20 AND cx + half <= 2000 AND cy + half <= 1000000""",
        "bbox_expand": f"WITH {NEW} SELECT id, {grow('x0', -24)}, {grow('y0', -24)}, {grow('x1', 24)}, {grow('y1', 24)} FROM new",
        "footprint_shape_metrics": f"""WITH {OLD}, s AS (SELECT id, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h, (x0 + x1)::DOUBLE / 2 AS cx, (y0 + y1)::DOUBLE / 2 AS cy FROM old)
          SELECT id, w * h AS size, 2 * (w + h) AS length, cx, cy, 0 AS holes, round(4 * pi() * w * h / (4 * (w + h) * (w + h)), 9) AS compact, 0.0::DOUBLE AS hull_gap, round(greatest(w, h) / least(w, h), 9) AS elongation FROM s""",
        "polygon_iou_general": f"WITH {OLD}, {NEW} SELECT o.id, n.id AS other, round({_iou('o', 'n')}, 9) AS iou FROM old o JOIN new n ON {_meet('o', 'n')}",
        "rerank_candidates": f"""WITH {REPORT}, d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY object DESC, score DESC, iou DESC, area_diff DESC, shift DESC, kind DESC) = 1),
          q AS (SELECT id, part, kind > 0 AS usable, round((object % 97)::DOUBLE / 100, 9) AS raw, round(0.15::DOUBLE * ((object % 97)::DOUBLE / 100) + 0.4::DOUBLE * greatest(0, 1 - abs(1 + area_diff - 1)) + 0.2::DOUBLE * iou + 0.15::DOUBLE * greatest(0, 1 - shift / 7) + 0.1::DOUBLE * (iou / 2), 9) AS w FROM d)
          SELECT id, part, CASE WHEN usable THEN w ELSE raw END AS combined, usable AS reranked FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY usable DESC, CASE WHEN usable THEN w ELSE raw END DESC, part) = 1""",
        "segmentation_metrics": f"""WITH {REPORT}, k AS (SELECT object, (count(*) FILTER (iou > 0.5 AND score > 0.7))::DOUBLE AS tp, (count(*) FILTER (iou > 0.5 AND score <= 0.7))::DOUBLE AS fp, (count(*) FILTER (iou <= 0.5 AND score > 0.7))::DOUBLE AS fn FROM r GROUP BY 1),
          s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM k)
          SELECT object, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 9) AS iou, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM s""",
        "layer_pick": """WITH s AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, 'red') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'eco') OR contains(t, 'ring') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'widget') THEN 1 ELSE 0 END AS score FROM s ORDER BY 2 DESC, 1 DESC LIMIT 10""",
        "json_points": "WITH k AS (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events) SELECT event_id, CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN k % 3 > 0 THEN k * (k + 1) ELSE 0 END::DOUBLE AS total FROM k",
        "value_counts_nulls": f"WITH {TAX} SELECT best, count(*) AS n FROM t GROUP BY 1",
        "affine_pixels": f"WITH {OLD} SELECT id, floor(x0::DOUBLE / 2048 * 512)::BIGINT AS px, ceil((4096 - y1)::DOUBLE / 4096 * 1024)::BIGINT AS py FROM old",
        "union_bounds": f"WITH {OLD}, {NEW} SELECT min(x0) - 5 AS x0, min(y0) - 5 AS y0, max(x1) + 5 AS x1, max(y1) + 5 AS y1 FROM (SELECT * FROM old UNION ALL SELECT * FROM new)",
        "report_lines": f"""WITH {EXP}, m AS (SELECT experiment, {count("O")} AS o, {count("F")} AS f FROM e GROUP BY 1) SELECT experiment, replace(experiment, '-', '\\_') || ' & ' || o || '/' || f || ' & ' || printf('%06d', o) AS line FROM m""",
    }
