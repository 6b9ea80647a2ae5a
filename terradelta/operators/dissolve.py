"""Union of many geometries of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import overlay


def dissolve(df: DataFrame, keys: list[str], geometry: str, cell: float) -> DataFrame:
    """keys and the union of their geometries, parts that overlap or share an edge in one, the largest first. Null geometries add nothing.

    Neighbours are united first, by group and grid cell of their bounds' corner, so a group with very many members is worked on in many tasks and
    only outlines meet in the last step. A group's union is one row, which is all that has to fit into a task.
    """
    found = df.where(F.col(geometry).isNotNull()).select(*keys, F.col(geometry).alias("_g")).withColumn("_b", g.bounds(F.col("_g")))
    near = found.withColumns({"_x": F.floor(F.col("_b.x0") / cell), "_y": F.floor(F.col("_b.y0") / cell)})
    some = near.groupBy(*keys, "_x", "_y").agg(F.flatten(F.collect_list("_g")).alias("_g")).select(*keys, overlay.repaired(F.col("_g")).alias("_g"))
    return some.groupBy(*keys).agg(F.flatten(F.collect_list("_g")).alias("_g")).select(*keys, overlay.repaired(F.col("_g")).alias(geometry))


def largest(geometry: str):
    """The largest polygon of a dissolved geometry, as a geometry."""
    return F.slice(geometry, 1, 1)
