"""Rule cascades as Column expressions: the first rule that holds decides. A missing measure (null or NaN) fails its rule.

Thresholds are fields of frozen dataclasses. Fixed values: their defaults, the order of the rules, and the reason strings are the published ones.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: error types by the refinement they call for
SHADOW = ("shadow_roof",)
TOPOLOGY = ("courtyard_structure", "multi_level_roof", "multi_part_roof")
CONTEXT = ("neighbor_merge", "wrong_building_focus")
GEOMETRY = ("oversegmentation", "undersegmentation", "polygon_geometry")


def first_match(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def nan_fails(*measures: str) -> Callable:
    """The rules with NaN as null in these measures: to Spark NaN is larger than every number, so it would pass any lower bound."""

    def of(rules: Callable) -> Callable:
        signature = inspect.signature(rules)

        @wraps(rules)
        def run(*args, **named):
            given = signature.bind(*args, **named)
            for k in measures:
                given.arguments[k] = F.nanvl(given.arguments[k], F.lit(None).cast("double"))
            return rules(*given.args, **given.kwargs)

        return run

    return of


@dataclass(frozen=True)
class UpdateRules:
    keep_iou: float = 0.85
    keep_area: float = 0.15
    keep_shift: float = 2.0
    update_iou: float = 0.25


@nan_fails("iou", "area_diff", "shift")
def update_decision(predicted: Column, iou: Column, area_diff: Column, shift: Column, r: UpdateRules = UpdateRules()) -> Column:
    """keep, update, flag_review, or flag_no_prediction where nothing was predicted."""
    stable = (iou >= r.keep_iou) & (F.abs(area_diff) <= r.keep_area) & (shift <= r.keep_shift)
    return first_match((~predicted, "flag_no_prediction"), (stable, "keep"), (iou >= r.update_iou, "update"), default="flag_review")


@dataclass(frozen=True)
class KeepBiasRules:
    keep_iou: float = 0.7
    keep_area: float = 0.15
    keep_shift: float = 1.5
    update_score: float = 0.94
    update_iou: float = 0.5
    update_area: float = 0.22
    update_shift: float = 2.0
    review_score: float = 0.85
    review_iou: float = 0.62
    review_area: float = 0.16
    review_shift: float = 1.2


@nan_fails("score", "iou", "area_diff", "shift")
def keep_bias_decision(score: Column, iou: Column, area_diff: Column, shift: Column, r: KeepBiasRules = KeepBiasRules()) -> Column:
    """keep unless the evidence for an update or a review is strong."""
    a = F.abs(area_diff)
    stable = (iou >= r.keep_iou) & (a <= r.keep_area) & (shift <= r.keep_shift)
    strong = (score >= r.update_score) & (iou <= r.update_iou) & (a >= r.update_area) & (shift >= r.update_shift)
    unsure = (score >= r.review_score) & ((iou <= r.review_iou) | (a >= r.review_area) | (shift >= r.review_shift))
    return first_match((stable, "keep"), (strong, "update"), (unsure, "flag_review"), default="keep")


def final_source(decision: Column) -> Column:
    return first_match((decision == "update", "sam2"), (decision == "flag_review", "osm_review"), default="osm")


@nan_fails("best_iou")
def snapshot_status(best_iou: Column, removed: float = 0.1, unchanged: float = 0.85) -> Column:
    """Of an old object by its best overlap with the new snapshot; none is 0."""
    iou = F.coalesce(best_iou, F.lit(0.0))
    return first_match((iou < removed, "removed_candidate"), (iou >= unchanged, "unchanged_candidate"), default="changed_candidate")


def evaluation_mode(status: Column, has_reference: Column) -> Column:
    matched = status.isin("unchanged_candidate", "changed_candidate") & has_reference
    return first_match((matched, "matched_reference"), (status == "removed_candidate", "removed_against_any_current"), default="unmatched")


@nan_fails("best_iou")
def removed_behavior(best_iou: Column) -> Column:
    return first_match((best_iou < 0.10, "still_removed_like"), (best_iou < 0.25, "weak_overlap_with_current"), default="snapped_to_current_building")


@nan_fails("iou")
def detection(iou: Column, good: float = 0.6, partial: float = 0.3) -> Column:
    """Of a new building."""
    return first_match((iou >= good, "good_detection"), (iou >= partial, "partial_detection"), default="missed_detection")


@dataclass(frozen=True)
class UncertaintyRules:
    iou_low: float = 0.55
    iou_medium: float = 0.75
    cv_medium: float = 0.15
    cv_high: float = 0.3
    spread_medium: float = 1.5
    spread_high: float = 3.0
    medium: int = 2
    high: int = 4


@nan_fails("pairwise_iou", "area_cv", "spread")
def uncertainty_points(pairwise_iou: Column, area_cv: Column, spread: Column, disagreement: Column, r: UncertaintyRules = UncertaintyRules()) -> Column:
    """0 to 7; every bound is strict."""
    return (
        first_match((pairwise_iou < r.iou_low, 2), (pairwise_iou < r.iou_medium, 1), default=0)
        + first_match((area_cv > r.cv_high, 2), (area_cv > r.cv_medium, 1), default=0)
        + first_match((spread > r.spread_high, 2), (spread > r.spread_medium, 1), default=0)
        + F.when(disagreement, 1).otherwise(0)
    )


def uncertainty_level(points: Column, r: UncertaintyRules = UncertaintyRules()) -> Column:
    return first_match((points >= r.high, "high"), (points >= r.medium, "medium"), default="low")


def suggested_refinement(level: Column, primary: Column) -> Column:
    return first_match(
        ((level == "low") | F.coalesce(primary == "stable_case", F.lit(False)), "no_refine"),
        *((primary.isin(*kinds), name) for kinds, name in ((SHADOW, "shadow_refine"), (TOPOLOGY, "topology_refine"), (CONTEXT, "context_refine"), (GEOMETRY, "geometry_refine"))),
        default="manual_review",
    )


def routing_decision(primary: Column, level: Column, disagreement: Column) -> Column:
    stable = primary == "stable_case"
    return first_match(
        (stable & (F.coalesce(disagreement, F.lit(False)) | F.coalesce(level == "medium", F.lit(False))), "review_keep"),
        (stable, "no_refine"),
        *((primary.isin(*kinds), name) for kinds, name in ((SHADOW, "shadow_refine"), (TOPOLOGY, "topology_refine"), (CONTEXT, "context_refine"), (GEOMETRY, "geometry_refine"))),
        default="manual_review",
    )


@dataclass(frozen=True)
class RouteRules:
    dark: float = 0.22
    drop: float = 18.0
    hull_gap: float = 0.08
    compact: float = 0.45
    edges: float = 0.1


@nan_fails("dark", "drop", "hull_gap", "compact", "edges")
def auto_route_v1(dark: Column, drop: Column, hull_gap: Column, compact: Column, edges: Column, level: Column, primary: Column, r: RouteRules = RouteRules()) -> Column:
    shape = (hull_gap >= r.hull_gap) | (compact <= r.compact) | F.coalesce(edges >= r.edges, F.lit(False))
    return first_match(((dark >= r.dark) & (drop >= r.drop), "shadow_refine"), (shape, "topology_refine"), ((level == "medium") & (primary == "stable_case"), "review_keep"), default="no_refine")


@dataclass(frozen=True)
class RouteRulesV2:
    dark: float = 0.18
    drop: float = 14.0
    inside_std: float = 20.0
    drop_relaxed: float = 10.0
    hull_gap: float = 0.08
    compact: float = 0.45
    edges: float = 0.16


@nan_fails("dark", "drop", "inside_std", "hull_gap", "compact", "edges")
def auto_route_v2(dark: Column, drop: Column, inside_std: Column, hull_gap: Column, compact: Column, edges: Column, level: Column, r: RouteRulesV2 = RouteRulesV2()) -> Column:
    shadow = ((dark >= r.dark) & (drop >= r.drop)) | ((inside_std >= r.inside_std) & (drop >= r.drop_relaxed))
    shape = (hull_gap >= r.hull_gap) | (compact <= r.compact) | F.coalesce((edges >= r.edges) & level.isin("medium", "high"), F.lit(False))
    return first_match((shadow, "shadow_refine"), (shape, "topology_refine"), (level == "medium", "review_keep"), default="no_refine")


@dataclass(frozen=True)
class AcceptanceRules:
    routes: tuple[str, ...] = ("topology_refine",)
    score: float = 0.72
    iou_drop: float = 0.05
    area_rise: float = 0.1
    reject_review: bool = True


@nan_fails("score", "iou", "area", "old_iou", "old_area")
def selective_acceptance(route: Column, score: Column, decision: Column, iou: Column, area: Column, old_iou: Column, old_area: Column, r: AcceptanceRules = AcceptanceRules()) -> tuple[Column, Column]:
    """Whether the second pass is taken, and why: each condition by name, or not_applicable."""
    on = route.isin(*r.routes)
    conditions = {
        "score": score >= r.score,
        "iou_drop": iou >= old_iou - r.iou_drop,
        "area": F.abs(area) <= F.abs(old_area) + r.area_rise,
        "review": ~((decision == "flag_review") & F.lit(r.reject_review)),
    }
    conditions = {k: F.coalesce(v, F.lit(False)) for k, v in conditions.items()}
    every = on
    for c in conditions.values():
        every = every & c
    reason = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.when(c, "True").otherwise("False")) for k, c in conditions.items()))
    return F.coalesce(every, F.lit(False)), F.when(on, reason).otherwise("not_applicable")


@dataclass(frozen=True)
class ShadowRules:
    score: float = 0.78
    iou: float = 0.55
    shift: float = 2.5
    least_ratio: float = 0.9
    most_ratio: float = 1.3


@nan_fails("score", "iou", "shift", "ratio")
def shadow_acceptance(score: Column, iou: Column, shift: Column, ratio: Column, r: ShadowRules = ShadowRules()) -> Column:
    """A missing prediction is never accepted."""
    return F.coalesce((score >= r.score) & (iou >= r.iou) & (shift <= r.shift) & (ratio >= r.least_ratio) & (ratio <= r.most_ratio), F.lit(False))


@dataclass(frozen=True)
class ChangeRules:
    keep_iou: float = 0.8
    keep_area: float = 0.18
    keep_shift: float = 1.5
    modified_score: float = 0.82
    modified_iou: float = 0.5
    modified_area: float = 0.6
    modified_shift: float = 10.0
    removed_iou: float = 0.18
    removed_score: float = 0.55
    special_score: float = 0.75
    special_iou: float = 0.45


@nan_fails("score", "iou", "area_diff", "shift")
def change_type(decision: Column, score: Column, iou: Column, area_diff: Column, shift: Column, route: Column, level: Column, special: Column, r: ChangeRules = ChangeRules()) -> Column:
    """Struct (type, reason) from what is known at run time; special: a specialised pass was accepted."""
    a, special = F.abs(area_diff), F.coalesce(special, F.lit(False))
    pair = lambda kind, why: F.struct(F.lit(kind).alias("type"), F.lit(why).alias("reason"))
    keep, update = decision == "keep", decision == "update"
    stable = (iou >= r.keep_iou) & (a <= r.keep_area) & (shift <= r.keep_shift)
    strong = (score >= r.modified_score) & (iou >= r.modified_iou) & (a <= r.modified_area) & (shift <= r.modified_shift)
    mixed = F.coalesce(level.isin("medium", "high"), F.lit(False)) | F.coalesce(route.isin("shadow_refine", "topology_refine", "context_refine"), F.lit(False))
    return first_match(
        (decision == "flag_review", pair("review", "flag_review_from_update_layer")),
        (keep & stable, pair("unchanged", "stable_keep_geometry")),
        (keep, pair("review", "keep_but_not_geometrically_stable")),
        (update & (iou <= r.removed_iou) & (score <= r.removed_score), pair("removed_candidate", "weak_current_object_evidence")),
        (update & strong, pair("modified", "strong_update_evidence")),
        (update & special & (score >= r.special_score) & (iou >= r.special_iou), pair("modified", "accepted_specialized_refinement")),
        (update & mixed, pair("review", "update_but_mixed_evidence")),
        (update, pair("modified", "default_update_case")),
        default=pair("review", "fallback"),
    )


@nan_fails("iou")
def reference_change_type(iou: Column, unchanged: float = 0.9) -> Column:
    return first_match((iou >= unchanged, "unchanged"), default="modified")


@nan_fails("concavity", "elongation", "compact")
def is_complex(holes: Column, concavity: Column, elongation: Column, compact: Column, least_concavity: float, most_elongation: float, least_compact: float) -> Column:
    return F.coalesce((holes > 0) | (concavity < least_concavity) | (elongation > most_elongation) | (compact < least_compact), F.lit(False))


#: Sources whose objects keep the original geometry.
ORIGINAL_SOURCES = ("osm", "orig", "original", "keep")


def final_geometry(source: Column, original: Column, predicted: Column) -> Column:
    """The original geometry where the source says so, else the predicted one; no source counts as predicted."""
    return F.when(F.coalesce(F.lower(source), F.lit("")).isin(*ORIGINAL_SOURCES), original).otherwise(predicted)
