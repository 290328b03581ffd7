"""Review state and people: latest marks, overrides, membership, facets, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.ranking import shifted

MARKS = ("keep", "reject", "unmarked")


def latest_decisions(log: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last entry of each key in an append-only log."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def mark(value: Column) -> Column:
    """One of the three marks; anything else is unmarked."""
    return F.when(value.isin("keep", "reject"), value).otherwise("unmarked")


def rating(value: Column) -> Column:
    """Stars from 1 to 5; 0 clears, and anything outside 0 to 5 is no rating."""
    return F.when(value.between(1, 5), value.cast("int"))


def overridden(auto: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Automatic assignments with manual ones (one per key) on top; keys that only the overrides have are added."""
    return auto.join(overrides.select(key, F.col(value).alias("_manual")), key, "full_outer").withColumn(value, F.coalesce("_manual", value)).drop("_manual")


def rename_groups(bridge: DataFrame, renames: DataFrame, group: str = "person_id") -> DataFrame:
    """Merge groups: ``renames (from_id, to_id)`` moves all faces of one group into another; the rest stay."""
    moved = renames.select(F.col("from_id").alias(group), F.col("to_id").alias("_to"))
    return bridge.join(moved, group, "left").withColumn(group, F.coalesce("_to", group)).drop("_to")


def photos_of(photos: DataFrame, bridge: DataFrame, people: Column, key: str = "photo_id") -> DataFrame:
    """Photos that show any of the people chosen; a photo in several groups comes once."""
    return photos.join(bridge.where(people), key, "left_semi")


def facet_counts(photos: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """One row with the number of photos each predicate holds for; all in one pass."""
    return photos.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in facets.items()])


def filtered(photos: DataFrame, any_of: list[Column], all_of: list[Column] = ()) -> DataFrame:
    """Photos that satisfy one of the first predicates (if there are any) and all of the second."""
    for p in all_of:
        photos = photos.where(p)
    if any_of:
        hit = any_of[0]
        for p in any_of[1:]:
            hit = hit | p
        photos = photos.where(hit)
    return photos


def neighbours(photos: DataFrame, folder: str, order: str, key: str = "photo_id") -> DataFrame:
    """``photos`` with the previous and next photo of the display order inside each folder."""
    return shifted(photos, [folder], [F.col(order), F.col(key)], key, "previous_id", "next_id")
