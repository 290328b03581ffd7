"""Per-photo signals: histograms, flags, subject choice, scene rules, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Limits(NamedTuple):
    """This engine's thresholds; all are parameters."""

    eye_open: float = 0.2
    focus: float = 0.35
    exposure_review: float = 1.0
    exposure_strict: float = 2.0
    clipped_share: float = 0.1


def exposure_penalty(offset: Column, unrecoverable: Column, limits: Limits = Limits()) -> Column:
    """``heavy`` beyond the strict offset or over a large unrecoverable area, ``review`` where recoverable, else ``none``."""
    off = F.abs(offset)
    return F.when((off > limits.exposure_strict) | (unrecoverable > limits.clipped_share), "heavy").when(off > limits.exposure_review, "review").otherwise("none")


def findings(photos: DataFrame, id_col: str = "photo_id", limits: Limits = Limits()) -> DataFrame:
    """``(id, findings)``: codes with severity and evidence, from eye_open, focus, exposure, clipped and scene.

    In scenes without people an eye flag means nothing; a landscape may be soft in parts.
    """
    def item(code: str, when: Column, severity: Column, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), evidence.cast("double").alias("evidence")))

    people = ~F.coalesce(F.col("scene").isin("landscape", "product", "empty"), F.lit(False))
    focus_limit = F.when(F.col("scene") == "landscape", limits.focus * 0.8).otherwise(limits.focus)
    exposure = exposure_penalty(F.col("exposure"), F.col("clipped"), limits)
    found = F.array(
        item("closed_eye", people & (F.col("eye_open") < limits.eye_open), F.lit("heavy"), F.col("eye_open")),
        item("missed_focus", F.col("focus") < focus_limit, F.lit("heavy"), F.col("focus")),
        item("exposure", exposure != "none", exposure, F.col("exposure")),
        item("lost_detail", F.col("clipped") > limits.clipped_share, F.lit("review"), F.col("clipped")),
    )
    return photos.select(id_col, F.array_compact(found).alias("findings"))


def main_subject(faces: DataFrame, photo_col: str = "photo_id", score_col: str = "subject_score", face_col: str = "face_id") -> DataFrame:
    """The face with the best subject score of each photo; background faces are ignored from here on."""
    order = Window.partitionBy(photo_col).orderBy(F.col(score_col).desc_nulls_last(), face_col)
    return faces.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fused_score(aesthetic: Column, *signals: Column, weights: tuple[float, ...] = (0.6, 0.1, 0.1, 0.1, 0.1)) -> Column:
    """Weighted mean of the aesthetic score and the detectors' scores; missing ones drop out of the mean."""
    parts = list(zip((aesthetic, *signals), weights))
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(total > 0, value / total)


def histogram(values: DataFrame, key: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts per key and bin of equal width; values outside the range count in the end bins."""
    position = F.floor((F.col(value) - low) / ((high - low) / bins))
    return values.where(F.col(value).isNotNull()).groupBy(key, F.greatest(F.lit(0), F.least(F.lit(bins - 1), position)).cast("int").alias("bin")).count()


def batch_inference(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run a model over Arrow batches: ``load`` is called once per task, its result once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)
