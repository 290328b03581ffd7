"""Picks: hard gates before any ranking, one representative per duplicate group, a ratio of the singles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.ranking import global_rank

#: Strict pick ratios in percent.
STRICT_RATIOS = (38, 45, 50)


def hard_gate(photos: DataFrame, *excluded: DataFrame, key: str = "photo_id") -> DataFrame:
    """Photos in none of the excluded sets; runs before ranking, so no score can undo it."""
    for out in excluded:
        photos = photos.join(out.select(key).distinct(), key, "left_anti")
    return photos


def best_of_group(photos: DataFrame, group: str, usable: Column, *order: Column, key: str = "photo_id") -> DataFrame:
    """``photos`` with ``is_best``: the first usable row of each group in the given order; a group without one has none.

    ``key`` is unique. The filter on the rank lets each task keep one row of a group before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    best = photos.where(usable).withColumn("_n", rank).where("_n = 1").select(key, F.lit(True).alias("_best"))
    return photos.join(best, key, "left").withColumn("is_best", F.coalesce("_best", F.lit(False))).drop("_best")


def ratio_picks(photos: DataFrame, percent: int, score: Column, tie: str) -> DataFrame:
    """The best ``ceil(n * percent / 100)`` rows by score with their ranks; ties go by the unique column ``tie``, nulls come last."""
    limit = -(-photos.count() * percent // 100)
    ranked = global_rank(photos.withColumn("_score", score.cast("double")), [F.col("_score").desc_nulls_last(), F.col(tie)], "pick_rank")
    return ranked.where(F.col("pick_rank") <= limit).drop("_score")


def assisted_order(aesthetic: Column, persona: Column | None = None, blend: float = 0.3) -> Column:
    """Ranking score; the persona score only takes part when it is given, and never reaches the gates."""
    return aesthetic if persona is None else aesthetic * (1 - blend) + F.coalesce(persona, aesthetic) * blend
