"""Photo files as a scan: recursive, content read only where a later step asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_photos(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """``(path, modificationTime, length)`` of all files below a folder, with ``content`` if wanted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found if content else found.drop("content")
