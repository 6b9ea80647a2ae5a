"""Views of the star tables as footprints, reports, experiments, labels and candidates; all whole numbers or plain fractions, so other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import parquet

c = F.col


def boxes(df: DataFrame, id_: Column, x0: Column, y0: Column, w: Column, h: Column, *more: Column) -> DataFrame:
    wide = df.select(id_.cast("long").alias("id"), x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), w.cast("long").alias("w"), h.cast("long").alias("h"), *more)
    return wide.select("id", "x0", "y0", (c("x0") + c("w")).alias("x1"), (c("y0") + c("h")).alias("y1"), *(m for m in wide.columns[5:]))


def old_footprints(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey")
    return boxes(parquet(spark, sf, "part"), k, k % 50 * 40, F.floor(k / 50) * 40, 10 + c("p_size") % 15, 10 + k % 13)


def new_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Some gone, some moved, some grown, some added."""
    k = c("p_partkey")
    moved = F.when(k % 4 == 0, 1).otherwise(0)
    width = F.when(k % 29 == 0, 70).otherwise(10 + c("p_size") % 15 + F.when(k % 7 == 0, 6).otherwise(0))
    stay = boxes(parquet(spark, sf, "part").where(k % 17 != 0), k, k % 50 * 40 + moved * (k % 5), F.floor(k / 50) * 40 + moved * (k % 3), width, 10 + k % 13)
    s = c("s_suppkey")
    return stay.unionByName(boxes(parquet(spark, sf, "supplier"), s + 1_000_000_000, s * 40 + 100_000, F.lit(0), F.lit(20), F.lit(20)))


def final_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """What an update left of the old objects."""
    k = c("p_partkey")
    return boxes(parquet(spark, sf, "part"), k, k % 50 * 40 + c("p_size") % 4, F.floor(k / 50) * 40, 10 + c("p_size") % 15 + k % 3, 10 + k % 13)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of predicted objects, with missing predictions, from order lines."""
    n = c("l_linenumber")
    return parquet(spark, sf, "lineitem").select(
        c("l_orderkey").alias("id"), n.alias("part"), (n % 7 != 0).alias("pred"), (c("l_quantity") / 50).alias("iou"), (c("l_tax") * 10 - 0.4).alias("area_diff"), (c("l_discount") * 50).alias("shift"),
        ((c("l_orderkey") % 51 + 50) / 100).alias("score"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("line_status"), (c("l_partkey") % 10).alias("kind"), (c("l_suppkey") % 3).alias("grade"), c("l_partkey").alias("object"),
    )


# fixed values: error types of the bindings, by number
KINDS = ("stable_case", "shadow_roof", "courtyard_structure", "multi_level_roof", "multi_part_roof", "neighbor_merge", "wrong_building_focus", "oversegmentation", "polygon_geometry", "unknown")
LEVELS = ("low", "medium", "high")


def named(index: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Objects' measures under several experiments, in long form: object, experiment, step, value, decision."""
    step = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return parquet(spark, sf, "orders").select(c("o_custkey").alias("id"), c("o_orderpriority").alias("experiment"), step.alias("step"), (c("o_totalprice") / 1000).alias("value"), c("o_orderstatus").alias("decision"), c("o_orderkey").alias("key"))
