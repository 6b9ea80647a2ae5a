import pytest
from pyspark.sql import functions as F

from terradelta.operators import rules

c = F.col


def one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).cast("double" if isinstance(v, float) or v is None else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "int").alias(k) for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("pred", "iou", "area", "shift", "want"),
    [(False, None, None, None, "flag_no_prediction"), (True, 0.85, -0.15, 2.0, "keep"), (True, 0.85, 0.16, 2.0, "update"), (True, 0.25, 9.0, 9.0, "update"), (True, 0.2499, 0.0, 0.0, "flag_review")],
)
def test_update_decision(spark, pred, iou, area, shift, want):
    assert one(spark, rules.update_decision(c("p"), c("i"), c("a"), c("s")), p=pred, i=iou, a=area, s=shift) == want


@pytest.mark.parametrize(
    ("score", "iou", "area", "shift", "want"),
    [(0.1, 0.7, 0.15, 1.5, "keep"), (0.94, 0.5, 0.22, 2.0, "update"), (0.85, 0.62, 0.0, 0.0, "flag_review"), (0.84, 0.1, 0.9, 9.0, "keep")],
)
def test_keep_bias(spark, score, iou, area, shift, want):
    assert one(spark, rules.keep_bias_decision(c("c"), c("i"), c("a"), c("s")), c=score, i=iou, a=area, s=shift) == want


@pytest.mark.parametrize(("iou", "want"), [(None, "removed_candidate"), (0.0999, "removed_candidate"), (0.1, "changed_candidate"), (0.85, "unchanged_candidate")])
def test_snapshot_status(spark, iou, want):
    assert one(spark, rules.snapshot_status(c("i")), i=iou) == want


@pytest.mark.parametrize(("iou", "want"), [(0.0999, "still_removed_like"), (0.1, "weak_overlap_with_current"), (0.25, "snapped_to_current_building")])
def test_removed(spark, iou, want):
    assert one(spark, rules.removed_behavior(c("i")), i=iou) == want


def test_uncertainty_bounds_are_strict(spark):
    points = rules.uncertainty_points(c("p"), c("v"), c("s"), c("d"))
    assert one(spark, points, p=0.75, v=0.15, s=1.5, d=False) == 0
    assert one(spark, points, p=0.55, v=0.3, s=3.0, d=True) == 4
    assert one(spark, points, p=0.54, v=0.31, s=3.01, d=True) == 7


def test_missing_reference_is_modified(spark):
    assert one(spark, rules.reference_change_type(c("i")), i=None) == "modified"
    assert one(spark, rules.reference_change_type(c("i")), i=0.9) == "unchanged"


def test_missing_prediction_is_not_accepted(spark):
    ok = rules.shadow_acceptance(c("c"), c("i"), c("s"), c("r"))
    assert one(spark, ok, c=0.78, i=0.55, s=2.5, r=1.3) is True
    assert one(spark, ok, c=0.9, i=None, s=None, r=None) is False


def test_routes(spark):
    route = rules.routing_decision(c("p"), c("l"), c("d"))
    assert one(spark, route, p="stable_case", l="medium", d=False) == "review_keep"
    assert one(spark, route, p="stable_case", l="low", d=False) == "no_refine"
    assert one(spark, route, p="multi_part_roof", l="low", d=False) == "topology_refine"
    assert one(spark, route, p="other", l="high", d=True) == "manual_review"


def test_acceptance_reason(spark):
    accepted, reason = rules.selective_acceptance(c("r"), c("c"), c("d"), c("i"), c("a"), c("oi"), c("oa"))
    values = dict(r="topology_refine", c=0.72, d="update", i=0.45, a=-0.2, oi=0.5, oa=0.1)
    assert one(spark, accepted, **values) is True
    assert one(spark, reason, **values | {"d": "flag_review"}) == "score=True;iou_drop=True;area=True;review=False"
    assert one(spark, reason, **values | {"r": "no_refine"}) == "not_applicable"


def test_a_measure_that_is_no_number_fails_its_rule(spark):
    nan = float("nan")
    assert one(spark, rules.auto_route_v2(c("d"), c("r"), c("s"), c("h"), c("k"), c("e"), F.lit("low")), d=nan, r=20.0, s=0.0, h=0.0, k=0.9, e=0.0) == "no_refine"
    assert one(spark, rules.auto_route_v1(c("d"), c("r"), c("h"), c("k"), c("e"), F.lit("low"), F.lit("x")), d=nan, r=nan, h=nan, k=nan, e=nan) == "no_refine"
    assert one(spark, rules.update_decision(F.lit(True), c("i"), c("a"), c("s")), i=nan, a=0.0, s=0.0) == "flag_review"
    assert one(spark, rules.keep_bias_decision(c("c"), c("i"), c("a"), c("s")), c=nan, i=0.1, a=nan, s=nan) == "keep"
    assert one(spark, rules.detection(c("i")), i=nan) == "missed_detection"
    assert one(spark, rules.selective_acceptance(F.lit("topology_refine"), c("s"), F.lit("keep"), c("i"), c("a"), c("o"), c("p"))[0], s=nan, i=0.9, a=0.0, o=0.9, p=0.0) is False
    assert one(spark, rules.uncertainty_points(c("i"), c("a"), c("s"), F.lit(False)), i=0.9, a=nan, s=nan) == 0


@pytest.mark.parametrize(("holes", "concavity", "elongation", "compact", "want"), [(1, 1.0, 1.0, 1.0, True), (0, 0.79, 1.0, 1.0, True), (0, 0.8, 3.0, 0.3, False), (0, 0.9, 3.1, 1.0, True), (0, 0.9, 1.0, 0.29, True), (0, float("nan"), float("nan"), float("nan"), False)])
def test_complexity(spark, holes, concavity, elongation, compact, want):
    assert one(spark, rules.is_complex(c("h"), c("c"), c("e"), c("k"), 0.8, 3.0, 0.3), h=holes, c=concavity, e=elongation, k=compact) is want
