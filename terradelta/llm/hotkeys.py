"""An inner join on a key that a large share of the rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many, so there are fewer hot keys than this, whatever the size of the table.
SHARE = 256


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with counted (one row for each value of `key`, which has `count` of the `total` rows) on key.

    Rows of hot keys stay where they are and meet the fewer than SHARE rows of counted that can be hot; the others meet by a shuffle in which no key
    has more than one row in SHARE. Keys that are null find nothing.
    """
    hot = F.col(count) * SHARE > F.lit(total)
    few = F.broadcast(counted.where(hot))
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(counted.where(~hot), key))
