"""Files to photos: format filter and pairing of raw and rendered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw formats, and the rendered ones they pair with.
RAW_FORMATS = ["cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "srw", "dng"]
JPEG_FORMATS = ["jpg", "jpeg"]


def split_path(path: Column) -> tuple[Column, Column, Column]:
    """Folder, stem and lower-case extension; a name without a dot has no extension."""
    folder = F.regexp_extract(path, r"^(.*?)/?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r".\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    return folder, stem, F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))


def files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``(path, dir, stem, ext, kind)`` of the files of known formats; kind is raw or jpg."""
    folder, stem, ext = split_path(F.col(path_col))
    kind = F.when(ext.isin(RAW_FORMATS), "raw").when(ext.isin(JPEG_FORMATS), "jpg")
    return paths.select(F.col(path_col).alias("path"), folder.alias("dir"), stem.alias("stem"), ext.alias("ext"), kind.alias("kind")).where("kind is not null")


def pair_photos(files: DataFrame) -> DataFrame:
    """One photo per folder and stem (case ignored): ``(dir, stem_key, raw_path, jpg_path)``, singles kept.

    Of several files of a kind under one name the first path counts. A grouping
    does the full outer pairing in one shuffle.
    """
    return (
        files.groupBy("dir", F.lower("stem").alias("stem_key"))
        .agg(F.min(F.when(F.col("kind") == "raw", F.col("path"))).alias("raw_path"), F.min(F.when(F.col("kind") == "jpg", F.col("path"))).alias("jpg_path"))
    )
