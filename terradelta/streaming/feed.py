"""Decisions over a stream of reports: rules hold row by row, so the batch expressions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import UpdateRules, update_decision


def decisions(reports: DataFrame, rules: UpdateRules = UpdateRules()) -> DataFrame:
    """reports (batch or stream) with pred, iou, area_diff, shift columns, and the decision."""
    c = F.col
    return reports.withColumn("decision", update_decision(c("pred"), c("iou"), c("area_diff"), c("shift"), rules))


def decision_counts(decided: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of decisions by time window; rows later than `late` are left out of a stream."""
    return decided.withWatermark(time, late).groupBy(F.window(time, window), "decision").count()
