"""Connected components of an edge table by alternating stars: every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its partners, beside each partner v."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _linked_to_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    linked = _linked_to_least(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node it is connected with) for each node of the edges, columns u and v.

    Nulls and loops are left out. A node of very many edges is a hot key of joins only, which Spark divides; its
    minimum is combined before the shuffle. Each round is written to the shared folder.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    mark = None
    while True:
        new_mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_mark == mark or new_mark[0] == 0:
            break
        mark = new_mark
        now = cut(_small_star(cut(_large_star(now))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
