"""Choice of the best candidate of each object by a weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of the published rankings
TOPOLOGY = {"sam_score": 0.2, "prior_iou": 0.3, "area_consistency": 0.2, "bbox_iou_prior": 0.15, "centroid_consistency": 0.1, "shape_match": 0.05}
SHADOW = {"sam_score": 0.25, "prior_iou": 0.25, "area_consistency": 0.25, "centroid_consistency": 0.15, "compactness": 0.1}
CHANGED = {"sam_score": 0.15, "area_consistency": 0.4, "bbox_iou_hist": 0.2, "centroid_consistency": 0.15, "hist_mask_iou": 0.1}
NEW_BUILDING = {"sam_score": 0.25, "centeredness": 0.35, "area_reasonableness": 0.25, "compactness_proxy": 0.15}
NEW_BUILDING_AREA = (0.01, 0.4)
PRIOR_GUIDED = {"iou_prior": 0.3, "precision_prior": 0.2, "recall_prior": 0.2, "area_consistency": 0.2, "sam_score": 0.1}


def area_consistency(size: Column, reference: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(size / F.greatest(reference, F.lit(1.0)) - 1))


def centroid_consistency(distance: Column, diagonal: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / F.greatest(0.35 * diagonal, F.lit(1.0))), F.lit(0.0))


def shape_match(concavity: Column, prior: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(concavity - prior))


def fill_ratio(size: Column, width: Column, height: Column) -> Column:
    """Pixels of a mask against those of its bounds, 0 for an empty one."""
    return F.coalesce(F.try_divide(size.cast("double"), F.greatest(width * height, F.lit(1)).cast("double")), F.lit(0.0))


def centredness(distance: Column, diagonal: Column) -> Column:
    """1 in the image's middle, 0 from three tenths of its diagonal on."""
    return F.greatest(F.lit(0.0), 1 - distance / F.greatest(0.3 * diagonal, F.lit(1.0)))


def area_reasonableness(share: Column, least: float, most: float) -> Column:
    """1 in the middle between the two shares of the image, falling to 0 at either."""
    return F.when(share.between(least, most), F.greatest(F.lit(0.0), 1 - F.abs(share - (least + most) / 2) / max((most - least) / 2, 1e-6))).otherwise(0.0)


def overlap_measures(inter: Column, size: Column, prior: Column) -> dict[str, Column]:
    """iou, precision and recall of a mask against the prior one, 0 where a denominator is."""
    ratio = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    return {"iou_prior": ratio(inter, size + prior - inter), "precision_prior": ratio(inter, size), "recall_prior": ratio(inter, prior)}


def weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * F.coalesce(F.col(name), F.lit(0.0))
    return out


def best_candidate(df: DataFrame, key: str, index: str, combined: Column, usable: Column, raw: Column) -> DataFrame:
    """key, the chosen index and its combined score: the highest among usable candidates, the first of equal ones; without one, the highest raw score."""
    rank = F.struct(usable.alias("u"), F.when(usable, combined).otherwise(raw).alias("combined"), (-F.col(index)).alias("i"))
    best = df.groupBy(key).agg(F.max(rank).alias("best"))
    return best.select(key, (-F.col("best.i")).alias(index), F.col("best.combined").alias("combined"), F.col("best.u").alias("reranked"))
