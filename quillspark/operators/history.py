"""The flat history of stored snapshots, and the rows of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions.coerce import collated, markdown_cell, signed
from quillspark.operators.counters import first_by


def latest_per_date(snapshots: DataFrame) -> DataFrame:
    """One snapshot per date, the one captured last; of equal times the first in the input (``ordinal`` if there is one)."""
    if "ordinal" not in snapshots.columns:
        snapshots = snapshots.withColumn("ordinal", F.monotonically_increasing_id())
    return first_by(snapshots, ["date"], [F.col("capturedAt").desc(), F.col("ordinal")])


def unnested(snapshots: DataFrame) -> DataFrame:
    """``schema.HISTORY`` rows of documents, unordered, with the columns that order them; releases without assets leave no row."""
    releases = latest_per_date(snapshots).select("date", "capturedAt", F.posexplode("releases").alias("release_nth", "release"))
    rows = releases.select("date", "capturedAt", "release_nth", "release", F.posexplode("release.assets").alias("asset_nth", "asset"))
    a, r = F.col("asset"), F.col("release")
    return rows.select(
        "date", F.col("capturedAt").alias("captured_at"), r["tagName"].alias("release_tag"), r["name"].alias("release_name"), r["prerelease"].alias("is_prerelease"),
        a["id"].alias("asset_id"), a["name"].alias("asset_name"), a["sizeBytes"].alias("size_bytes"), a["downloadCount"].alias("download_count"),
        a["downloadDelta"].alias("download_delta"), a["trackingState"].alias("tracking_state"), "release_nth", "asset_nth",
    )


def history(snapshots: DataFrame) -> DataFrame:
    """``schema.HISTORY`` rows by capture time and stored order; deltas are read, never recomputed."""
    return ordered(unnested(snapshots))


def state_history(rows: DataFrame) -> DataFrame:
    """``schema.HISTORY`` rows of flat state rows, unordered, with the columns that order them (``ORDER``)."""
    asset = {"date": "date", "captured_at": "capturedAt", "release_tag": "tagName", "release_name": "releaseName", "is_prerelease": "prerelease", "asset_id": "id", "asset_name": "name", "size_bytes": "sizeBytes", "download_count": "downloadCount", "download_delta": "downloadDelta", "tracking_state": "trackingState"}
    return rows.where("kind = 'asset'").select(*[F.col(c).alias(n) for n, c in asset.items()], "release_nth", "asset_nth")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of :func:`state_history` by capture time, collated as the look-up of earlier snapshots is, and stored order; dealt by ranges."""
    return rows.orderBy(collated(F.col("captured_at")), "captured_at", "release_nth", "asset_nth").drop("release_nth", "asset_nth")


def report_rows(snapshot: DataFrame) -> DataFrame:
    """The report's table lines of one snapshot, in stored order."""
    rows = snapshot.select(F.posexplode("releases").alias("_r", "release")).select("_r", "release", F.posexplode("release.assets").alias("_a", "asset"))
    a = F.col("asset")
    line = F.concat(
        F.lit("| "),
        F.concat_ws(" | ", markdown_cell(F.col("release.tagName")), markdown_cell(a["name"]), a["downloadCount"].cast("string"), signed(a["downloadDelta"]), a["trackingState"]),
        F.lit(" |"),
    )
    return rows.orderBy("_r", "_a").select(line.alias("line"))
