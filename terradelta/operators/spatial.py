"""Best-overlap and nearest joins of objects with an id and bounds in x0, y0, x1, y1 columns.

Ids and bounds alone go through grid cells and are joined on equal cells, so no pair of far-away objects is ever made and no geometry is shuffled
before there are pairs; other columns come back by id. All these joins sort and merge: none gathers a side in the driver. A pair that shares several cells is kept in one of them. Large objects lie in larger cells.
Ids are unique on each side. Nothing is run while a join is built, but for the matches of matched_or_nearest, which are written once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_distance2
from ..sources.tables import merging, written

BOUNDS = ("x0", "y0", "x1", "y1")
#: Cells of level k are STEP**k times as large as those of level 0. An object that is larger than a cell of the last level lies in many of these.
STEP, TOP = 8, 3
#: All small objects meet the few large ones in large cells: they are dealt out over so many parts of a cell of each level, large ones are in all parts.
PARTS = (1, 4, 16, 64)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _bounds(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("id").alias(f"{prefix}id"), *(F.col(k).alias(prefix + k) for k in BOUNDS))


def _level(p: str, cell: float, step: int, top: int) -> Column:
    """The least level whose cells an object's longer side fits into, so that it lies in at most four of them."""
    side = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")).cast("double")
    return F.least(F.greatest(F.ceil(F.log(F.greatest(side / cell, F.lit(1.0))) / math.log(step)), F.lit(0)), F.lit(top)).cast("int")


def _size(cell: float, step: int, level: Column) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(float(step)), level)


def _small(df: DataFrame, p: str, cell: float, least: int) -> DataFrame:
    """Each object in the cells of all levels from its own, and `least` above that, in one part of each cell."""
    own = df.withColumn("own", _level(p, cell, STEP, TOP))
    wide = own.where(F.col("own") + least <= TOP).withColumn("level", F.explode(F.sequence(F.col("own") + least, F.lit(TOP))))
    return _placed(wide, p, cell).withColumn("part", F.pmod(F.xxhash64(f"{p}id"), F.get(F.array(*map(F.lit, PARTS)), F.col("level"))).cast("int")).drop("own")


def _large(df: DataFrame, p: str, cell: float) -> DataFrame:
    """Each object in the cells of its own level, in all parts of each."""
    wide = _placed(df.withColumn("level", _level(p, cell, STEP, TOP)), p, cell)
    return wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.array(*map(F.lit, PARTS)), F.col("level")) - 1)))


def _placed(df: DataFrame, p: str, cell: float) -> DataFrame:
    at = lambda k: F.floor(F.col(p + k) / _size(cell, STEP, F.col("level")))
    return df.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))


def overlapping(left: DataFrame, right: DataFrame, cell: float, touching: bool = False) -> DataFrame:
    """All pairs whose bounds overlap (or touch), with all columns, prefixed l_ and r_. cell: about the size of a usual object.

    A pair meets in cells of the level of its larger object, wherever the other one is smaller.
    """
    a, b = _bounds(left, "l_"), _bounds(right, "r_")
    c = F.col
    once = lambda k: c("c" + k) == F.floor(F.greatest(f"l_{k}0", f"r_{k}0") / _size(cell, STEP, c("level")))
    before = (lambda x, y: c(x) <= c(y)) if touching else (lambda x, y: c(x) < c(y))
    meet = before("l_x0", "r_x1") & before("r_x0", "l_x1") & before("l_y0", "r_y1") & before("r_y0", "l_y1")
    keys = ["level", "cx", "cy", "part"]
    smaller_left = _small(a, "l_", cell, 0).join(merging(_large(b, "r_", cell)), keys)
    smaller_right = _large(a, "l_", cell).join(merging(_small(b, "r_", cell, 1)), keys)
    names = ["l_id", "r_id", *("l_" + k for k in BOUNDS), *("r_" + k for k in BOUNDS)]
    pairs = smaller_left.select(*keys, *names).unionByName(smaller_right.select(*keys, *names)).where(once("x") & once("y") & meet).select(*names)
    return _widened(pairs, left, right)


def _widened(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with the other columns of both sides."""
    for df, p in ((left, "l_"), (right, "r_")):
        more = [k for k in df.columns if k not in BOUNDS]
        if more != ["id"]:
            pairs = pairs.join(merging(_prefixed(df.select(*more), p)), f"{p}id")
    return pairs


def matches(scored: DataFrame) -> DataFrame:
    """id, match_id and best_score: of `scored` (l_id, r_id, score) the best over 0 of each l_id; ties go to the least r_id, several may choose one."""
    best = scored.where("score > 0").groupBy(F.col("l_id").alias("id")).agg(F.max(F.struct("score", (-F.col("r_id")).alias("i"))).alias("_best"))
    return best.select("id", (-F.col("_best.i")).alias("match_id"), F.col("_best.score").alias("best_score"))


def best_overlap(left: DataFrame, right: DataFrame, score: Column, cell: float) -> DataFrame:
    """left with match_id and best_score (null where there is none) of the right object of the highest `score` of l_ and r_ columns."""
    return left.join(merging(matches(overlapping(left, right, cell).select("l_id", "r_id", score.alias("score")))), "id", "left")


#: Levels of the nearest search; the last one is one cell.
NEAR_STEP, NEAR_TOP = 4, 11


def nearest(left: DataFrame, right: DataFrame, distance2: Column, cell: float) -> DataFrame:
    """id, match_id and distance2 of the right object nearest to each left one, ties to the least id.

    Two joins on grid cells. First each left object meets one right object of every occupied cell around it, at all levels: the diagonal of both
    bounds together is more than their distance. Then it looks at all cells that its bounds, widened by that, lie in: of the least level that this
    width fits into, where all right objects up to this size are, and of every higher level, where only the right objects of that size are. So each
    object has a search of its own width, whatever the sizes of the objects it may find. `distance2` (of l_ and r_ columns) is worked out only where the
    bounds are near enough. It must be at least the squared distance of the bounds and at most that of their farthest corners.
    """
    c = F.col
    one, two = _bounds(left, "l_"), _bounds(right, "r_")
    size = _size(cell, NEAR_STEP, c("level"))
    every = F.explode(F.sequence(F.lit(0), F.lit(NEAR_TOP)))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    at = lambda value: F.when(c("level") == NEAR_TOP, 0).otherwise(F.floor(value / size))
    middle = lambda df, p: df.withColumns({"c" + k: at((c(f"{p}{k}0") + c(f"{p}{k}1")) / 2) for k in "xy"})

    some = middle(two.withColumn("level", every), "r_").groupBy("level", "cx", "cy").agg(F.min_by(F.struct(*two.columns), "r_id").alias("r")).select("level", "cx", "cy", "r.*")
    spread = middle(one.withColumn("level", every), "l_").withColumn("n", around).where((c("level") < NEAR_TOP) | ((c("n.i") == 0) & (c("n.j") == 0)))
    met = spread.withColumns({"cx": c("cx") + c("n.i"), "cy": c("cy") + c("n.j")}).drop("n").join(merging(some), ["level", "cx", "cy"])
    wide = lambda k: F.greatest(f"l_{k}1", f"r_{k}1") - F.least(f"l_{k}0", f"r_{k}0")
    bound = met.groupBy("l_id").agg(F.min((wide("x") * wide("x") + wide("y") * wide("y")).cast("double")).alias("bound"))

    own = two.withColumn("own", _level("r_", cell, NEAR_STEP, NEAR_TOP))
    held = own.withColumn("level", F.explode(F.sequence("own", F.lit(NEAR_TOP)))).withColumn("any", F.explode(F.when(c("own") == c("level"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).drop("own")
    cells = lambda k, p, by: F.explode(F.sequence(at(c(f"{p}{k}0") - by), at(c(f"{p}{k}1") + by)))
    held = held.withColumn("cx", cells("x", "r_", 0)).withColumn("cy", cells("y", "r_", 0))
    reach = F.sqrt("bound")
    side = 2 * reach + F.greatest(c("l_x1") - c("l_x0"), c("l_y1") - c("l_y0"))
    fit = F.least(F.greatest(F.ceil(F.log(F.greatest(side / float(cell), F.lit(1.0))) / math.log(NEAR_STEP)), F.lit(0)), F.lit(NEAR_TOP)).cast("int")
    looking = one.join(merging(bound), "l_id").withColumn("fit", fit).withColumn("level", F.explode(F.sequence("fit", F.lit(NEAR_TOP)))).withColumn("any", c("fit") == c("level"))
    looking = looking.withColumn("cx", cells("x", "l_", reach)).withColumn("cy", cells("y", "l_", reach)).drop("fit")
    near = looking.join(merging(held), ["level", "any", "cx", "cy"]).where(box_distance2("l_", "r_") <= c("bound"))
    names = ["l_id", "r_id", *("l_" + k for k in BOUNDS), *("r_" + k for k in BOUNDS)]
    pairs = _widened(near.select(*names).distinct(), left, right).select("l_id", "r_id", distance2.cast("double").alias("_d"))
    best = pairs.groupBy(c("l_id").alias("id")).agg(F.min(F.struct("_d", "r_id")).alias("_best"))
    return best.select("id", c("_best.r_id").alias("match_id"), c("_best._d").alias("distance2"))


def matched_or_nearest(left: DataFrame, scored: DataFrame, right: DataFrame, distance2: Column, cell: float, carried: dict[str, float] | None = None) -> DataFrame:
    """left with match_id and best_score: of `scored` (l_id, r_id, score, tie) the best by score, then least tie, then least id; the nearest where there is none.

    Objects without an overlap aren't lost: only they take the nearest search. carried: more columns of `scored` that come along, and what they are
    for an object without one. The matches are written to the shared folder, since they are used twice and a score may be dear.
    """
    extra = carried or {}
    best = scored.where("score > 0").groupBy(F.col("l_id").alias("id")).agg(F.max(F.struct("score", (-F.col("tie")).alias("t"), (-F.col("r_id")).alias("i"), *extra)).alias("_best"))
    hit = written(best.select("id", (-F.col("_best.i")).alias("match_id"), F.col("_best.score").alias("best_score"), *(F.col(f"_best.{k}").alias(k) for k in extra)))
    missed = left.join(merging(hit.select("id")), "id", "left_anti")
    near = nearest(missed, right, distance2, cell).select("id", "match_id", F.lit(0.0).alias("best_score"), *(F.lit(v).alias(k) for k, v in extra.items()))
    return left.join(merging(hit.unionByName(near)), "id", "left")


def hull_gap_frac(size: Column, hull: Column) -> Column:
    """(hull - size) / size, 0 if empty."""
    return F.coalesce(F.try_divide(hull - size, size), F.lit(0.0))
