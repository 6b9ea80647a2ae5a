"""Reports: counts, descriptions, ablations, confusion tables and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each value; null is one."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (exact, interpolated) and max of each group."""
    c = F.col(value)
    plain = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))
    middle = quantiles(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumnsRenamed({k: f"group {k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"group {k}")) for k in by]
    return plain.join(middle, same, "left").select(*by, "n", "mean", "std", "least", "q25", "q50", "q75", "most")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbours, without a group's values in one task.

    Equal values are counted together first; what is left is ranged over tasks by group and value, so a large group is in many. Each task adds up its
    own counts, and those of earlier tasks (a row for each task and group) come before them.
    """
    # names that no column of by has
    task, before, upto, same, every, v = "task of a value", "values before", "values up to", "values like it", "values of the group", "value itself"
    c, n = F.col, F.col(every)
    counts = df.where(c(value).isNotNull()).groupBy(*by, c(value).alias(v)).agg(F.count("*").alias(same))
    ranged = counts.repartitionByRange(*by, v).withColumn(task, F.spark_partition_id())
    summed = ranged.withColumn(upto, F.sum(same).over(Window.partitionBy(task, *by).orderBy(v)))
    parts = summed.groupBy(task, *by).agg(F.sum(same).alias(same))
    earlier = Window.partitionBy(*by).orderBy(task)
    parts = parts.select(task, *by, F.coalesce(F.sum(same).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(same).over(Window.partitionBy(*by)).alias(every))
    parts = parts.withColumnsRenamed({x: f"other {x}" for x in (task, *by)})
    placed = summed.join(parts, [c(x).eqNullSafe(c(f"other {x}")) for x in (task, *by)])
    last = c(before) + c(upto)
    wanted = {f"{name} {end}": f((n - 1) * F.lit(q)).cast("long") for name, q in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    held = [F.max(F.when((at >= last - c(same)) & (at < last), c(v))).alias(k) for k, at in wanted.items()]
    found = placed.groupBy(*by, every).agg(*held)
    mixed = lambda name, q: c(f"{name} low") + (c(f"{name} high") - c(f"{name} low")) * ((n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q)))
    return found.select(*by, *(mixed(name, q).alias(name) for name, q in shares.items()))


def crosstab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts for fixed labels, 0 where there are none; other labels are left out."""
    labels = df.sparkSession.createDataFrame([(x,) for x in rows], f"{row} string")
    counts = df.groupBy(row).pivot(column, columns).count()
    return labels.join(counts, row, "left").na.fill(0, columns)


def binary_measures(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1; a zero denominator gives null."""
    count = lambda c: F.count_if(c)
    cells = df.agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return cells.select("tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def segmentation_measures(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """iou, precision, recall and f1; 0 where a denominator is."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return {"iou": zero(F.try_divide(tp, tp + fp + fn)), "precision": precision, "recall": recall, "f1": zero(F.try_divide(2 * precision * recall, precision + recall))}


def step_differences(summary: DataFrame, order: str, value: str) -> DataFrame:
    """Adds the difference to the step before (0 for the first) and to the first step. summary has a row for each step, few in all."""
    w = Window.orderBy(order)
    c = F.col(value)
    return summary.withColumns({"delta_previous": F.coalesce(c - F.lag(c).over(w), F.lit(0.0)), "delta_first": c - F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def top(df: DataFrame, by: Column, key: str, n: int) -> DataFrame:
    """The n first rows by `by`, ties by key."""
    return df.orderBy(by, key).limit(n)


def fixed_counts(df: DataFrame | None, column: str, labels: tuple[str, ...], spark) -> DataFrame:
    """One row with the number of rows of each label, 0 without any, without the column or without the table."""
    if df is None or column not in df.columns:
        return spark.range(1).select(*(F.lit(0).cast("long").alias(x) for x in labels))
    return df.agg(*(F.count_if(F.col(column) == x).alias(x) for x in labels))


def mean_or_null(df: DataFrame, column: str) -> DataFrame:
    """One row with the column's mean; null where df has no such column."""
    return df.agg(F.avg(column).alias("mean")) if column in df.columns else df.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean"))


def spread(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Mean distance of a group's points to their mean point; 0 for fewer than two. Groups are small (an object's experiments) and meet once."""
    points = df.groupBy(by).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("points"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, a: s + a) / F.size(v)
    cx, cy = mean(F.transform("points", lambda p: p["x"].cast("double"))), mean(F.transform("points", lambda p: p["y"].cast("double")))
    far = mean(F.transform("points", lambda p: F.hypot(p["x"] - F.col("cx"), p["y"] - F.col("cy"))))
    return points.withColumns({"cx": cx, "cy": cy}).select(by, F.when(F.size("points") < 2, 0.0).otherwise(far).alias("spread"))


def united_or_empty(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    """The parts' rows, or none with the columns of `like`."""
    out = like.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def one_row(df: DataFrame, key: str, value) -> dict:
    """The row of that key as a dict; an error where there is none."""
    found = df.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not found:
        raise KeyError(f"{key} = {value!r}")
    return found[0].asDict()
