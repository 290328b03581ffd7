"""Export manifests and the preview cache; writers act on manifests, never on collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ranking import running_sum

RENDERED = {"jpeg": "jpg", "tiff": "tif", "png": "png"}
PROFILES = {"srgb": None, "adobe_rgb": "AdobeRGB1998.icc"}


def transfer_manifest(photos: DataFrame, target: str, move: bool) -> DataFrame:
    """``(source, destination, action)`` for originals; when a raw file moves, its XMP sidecar follows."""
    raw, jpg = F.col("raw_path"), F.col("jpg_path")
    sidecar = F.when(raw.isNotNull() & F.lit(move), F.concat(F.regexp_replace(raw, r"\.[^./]*$", ""), F.lit(".xmp")))
    listed = photos.select(F.explode(F.array_compact(F.array(raw, jpg, sidecar))).alias("source"))
    name = F.regexp_extract("source", r"([^/]*)$", 1)
    return listed.select("source", F.concat(F.lit(f"{target.rstrip('/')}/"), name).alias("destination"), F.lit("move" if move else "copy").alias("action"))


def collisions(manifest: DataFrame) -> DataFrame:
    """Destinations that more than one source claims."""
    return manifest.groupBy("destination").agg(F.count("*").alias("n")).where("n > 1")


def rating_manifest(photos: DataFrame, rating_col: str = "rating") -> DataFrame:
    """Where each rating goes: a sidecar beside a raw file, the metadata of a rendered one."""
    raw = F.col("raw_path")
    rated = photos.where(F.col(rating_col).between(0, 5))
    sidecar = rated.where(raw.isNotNull()).select(F.concat(F.regexp_replace(raw, r"\.[^./]*$", ""), F.lit(".xmp")).alias("target"), F.lit("xmp").alias("form"), F.col(rating_col).alias("rating"))
    inside = rated.where(F.col("jpg_path").isNotNull()).select(F.col("jpg_path").alias("target"), F.lit("metadata").alias("form"), F.col(rating_col).alias("rating"))
    return sidecar.unionByName(inside)


def xmp(rating: Column) -> Column:
    """A sidecar document that holds a rating."""
    return F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="'),
        rating.cast("string"), F.lit('"/></rdf:RDF></x:xmpmeta>'),
    )


def render_manifest(photos: DataFrame, target: str, form: str = "jpeg", quality: int = 90, profile: str = "srgb") -> DataFrame:
    """What to render where; quality from 1 to 100, and a profile file only where one must be embedded."""
    if form not in RENDERED or profile not in PROFILES or not 1 <= quality <= 100:
        raise ValueError("unknown form or profile, or quality outside 1 to 100")
    source = F.coalesce("raw_path", "jpg_path")
    stem = F.regexp_extract(source, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return photos.select(
        source.alias("source"), F.concat(F.lit(f"{target.rstrip('/')}/"), stem, F.lit(f".{RENDERED[form]}")).alias("destination"),
        F.lit(quality if form == "jpeg" else None).cast("int").alias("quality"), F.lit(PROFILES[profile]).cast("string").alias("icc"),
    )


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Previews that no cache entry of the same keys (photo, mode, engine version) serves."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def cache_size(cache: DataFrame, by: str = "mode", size: str = "bytes") -> DataFrame:
    return cache.groupBy(by).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def evict(cache: DataFrame, budget: int, by: str, time: str, tie: str, size: str = "bytes") -> DataFrame:
    """Entries to drop so that each ``by`` group keeps its newest ``budget`` bytes: a running sum from the newest back."""
    return running_sum(cache, [by], [F.col(time).desc(), F.col(tie).desc()], size, "_kept").where(F.col("_kept") > budget).drop("_kept")
