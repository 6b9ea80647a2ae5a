"""Reproducible samples: rows in the order of a seeded hash of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, or all if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def stratified(df: DataFrame, by: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """At most the quota of each stratum; strata without one are kept whole.

    Strata with a quota are ranked (Spark prunes the ranks before the shuffle), the others never shuffle.
    """
    ranked = df.where(F.col(by).isin(*quotas))
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    most = max(quotas.values(), default=0)
    taken = ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).where(F.col("nth") <= quota[F.col(by)]).drop("nth")
    return taken.unionByName(df.where(~F.coalesce(F.col(by).isin(*quotas), F.lit(False))))


def ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A number from 0 for each row in this order, without gathering the rows: they are ranged over tasks, and each task's numbers begin after the counts of those before.

    Rows that are filtered out later leave gaps, so the number is a lasting key. Ties of `order` are numbered in any order. The ranged rows are written to
    the shared folder: ranges come from a sample that each run of a plan draws anew, so counts and numbers have to see the same rows in the same task.
    """
    task, rank = "task of an ordinal", "rank in a task"
    ranged = written(df.repartitionByRange(*order).withColumn(task, F.spark_partition_id()))
    ranked = ranged.withColumn(rank, F.row_number().over(Window.partitionBy(task).orderBy(*order)))
    counts = ranked.groupBy(task).agg(F.count("*").alias("n"))
    before = counts.select(task, F.coalesce(F.sum("n").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each task
    return ranked.join(F.broadcast(before), task).withColumn(name, F.col("before") + F.col(rank) - 1).drop(task, rank, "before")


def first_of_rounded(df: DataFrame, keys: dict[str, int], order: str) -> DataFrame:
    """The first row, by `order`, of those whose columns are equal when rounded to so many digits."""
    rounded = [F.round(c, digits).alias(f"rounded {c}") for c, digits in keys.items()]
    first = df.groupBy(*rounded).agg(F.min_by(F.struct(*df.columns), order).alias("first"))
    return first.select("first.*")
