"""Schemas of raw releases, stored snapshots and the history table."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

LONG, TEXT, FLAG = LongType(), StringType(), BooleanType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


#: Sizes and counts are read as text, since the API's numbers are coerced, not trusted.
RAW_ASSET = _struct(id=LONG, name=TEXT, size=TEXT, download_count=TEXT, updated_at=TEXT, browser_download_url=TEXT)
RAW_RELEASES = _struct(id=LONG, tag_name=TEXT, name=TEXT, draft=FLAG, prerelease=FLAG, published_at=TEXT, html_url=TEXT, assets=ArrayType(RAW_ASSET))

ASSET = _struct(
    id=LONG, name=TEXT, sizeBytes=LONG, downloadCount=LONG, downloadDelta=LONG, trackingState=TEXT, previousAssetId=LONG, updatedAt=TEXT, downloadUrl=TEXT
)
RELEASE = _struct(id=LONG, tagName=TEXT, name=TEXT, prerelease=FLAG, publishedAt=TEXT, releaseUrl=TEXT, assets=ArrayType(ASSET))
TOTALS = _struct(releaseCount=LONG, assetCount=LONG, currentDownloads=LONG, downloadIncrease=LONG)
SNAPSHOT = _struct(
    schemaVersion=IntegerType(), repository=TEXT, capturedAt=TEXT, date=TEXT, previousDate=TEXT, totals=TOTALS, releases=ArrayType(RELEASE)
)
HISTORY = _struct(
    date=TEXT, captured_at=TEXT, release_tag=TEXT, release_name=TEXT, is_prerelease=FLAG, asset_id=LONG, asset_name=TEXT,
    size_bytes=LONG, download_count=LONG, download_delta=LONG, tracking_state=TEXT,
)

#: The flat form of snapshots: one row for each snapshot, release and asset (``kind``), with its place in the stored order.
STATE = _struct(
    repository=TEXT, capturedAt=TEXT, date=TEXT, previousDate=TEXT, kind=TEXT, release_nth=LONG, asset_nth=LONG,
    releaseId=LONG, tagName=TEXT, releaseName=TEXT, prerelease=FLAG, publishedAt=TEXT, releaseUrl=TEXT, **{f.name: f.dataType for f in ASSET.fields},
)

SCHEMA_VERSION = 1
