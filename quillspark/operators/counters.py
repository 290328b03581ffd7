"""Counter snapshots: as-of lookup, prioritised matching, clamped deltas, totals, and both forms of a snapshot: flat rows and a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from quillspark import schema
from quillspark.functions.coerce import collated, flag, name_or, non_negative_integer, text
from quillspark.operators.durable import durable
from quillspark.operators.ranking import global_rank, running_sum

STATES = ("existing", "replaced", "new")


def published(releases: DataFrame) -> DataFrame:
    """Drop drafts; a missing draft flag keeps the release."""
    return releases.where(~flag(F.col("draft")))


def as_of(snapshots: DataFrame, date: str, repository: str | None = None) -> DataFrame:
    """The newest snapshot of a strictly earlier date: one row at most. On files that are named, not partitioned, by date all are read."""
    earlier = snapshots.where(F.col("date") < F.lit(date))
    if repository is not None:
        earlier = earlier.where(F.col("repository") == repository)
    return earlier.orderBy(collated(F.col("capturedAt")).desc(), F.col("date").desc()).limit(1)


def flat_releases(raw: DataFrame) -> DataFrame:
    """Normalised releases with their position in the input (column ``ordinal`` if there is one)."""
    if "ordinal" not in raw.columns:
        raw = raw.withColumn("ordinal", F.monotonically_increasing_id())
    tag = text(F.col("tag_name"))
    return published(raw).select(
        "ordinal", "id", tag.alias("tagName"), name_or(F.col("name"), tag).alias("name"), flag(F.col("prerelease")).alias("prerelease"),
        F.col("published_at").alias("publishedAt"), F.col("html_url").alias("releaseUrl"),
        F.coalesce(F.col("assets"), F.array().cast(raw.schema["assets"].dataType)).alias("assets"),
    )


def flat_assets(releases: DataFrame) -> DataFrame:
    """One row per uploaded asset, its fields coerced, with its place in release and list."""
    a = F.col("asset")
    return releases.select("ordinal", "tagName", F.posexplode("assets").alias("place", "asset")).select(
        "ordinal", "place", "tagName", a["id"].alias("id"), text(a["name"]).alias("name"),
        non_negative_integer(a["size"]).alias("sizeBytes"), non_negative_integer(a["download_count"]).alias("downloadCount"),
        a["updated_at"].alias("updatedAt"), a["browser_download_url"].alias("downloadUrl"),
    )


def snapshot_assets(snapshots: DataFrame) -> DataFrame:
    """The assets of stored snapshots, flat, with their order within the snapshot."""
    none = F.array().cast(schema.SNAPSHOT["releases"].dataType)
    releases = snapshots.select(F.posexplode(F.coalesce("releases", none)).alias("r", "release"))
    no_assets = F.array().cast(ArrayType(schema.ASSET))
    assets = releases.select("r", F.col("release.tagName").alias("tagName"), F.posexplode(F.coalesce(F.col("release.assets"), no_assets)).alias("a", "asset"))
    return assets.select("r", "a", text(F.col("tagName")).alias("tagName"), F.col("asset.id").alias("id"), text(F.col("asset.name")).alias("name"), F.col("asset.downloadCount").alias("downloadCount"))


def last_by(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with the values of its last row by (r, a), which is unique in a snapshot.

    Both places are packed in one long, so that this is a hash aggregation with a
    partial step on the map side and no sort.
    """
    place = F.shiftleft(F.col("r").cast("bigint"), 32) + F.col("a")
    return df.groupBy(*keys).agg(*[F.max_by(v, place).alias(v) for v in values])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def match_states(current: DataFrame, previous: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Classify each current asset against one earlier snapshot and take its delta.

    ``current`` has id, tagName, name, downloadCount; ``previous`` the same with its
    order columns r and a. An id match (as text, whatever the tag) is ``existing``;
    else a match of tag and name is ``replaced`` and names the earlier id; else ``new``.
    ``existing`` counts what was added, never below 0; the others count in full.
    ``by`` names columns that say which snapshot each row compares with, to match many
    snapshots with their predecessors at once.
    Previous assets without a match leave no row. Both joins are equi-joins whose
    build sides hold one row per key; whether to broadcast is left to their size.
    """
    by = by or []
    named_ids = previous.where("id is not null").withColumn("id_text", F.col("id").cast("string"))
    by_id = last_by(named_ids.withColumn("before", non_negative_integer(F.col("downloadCount"))), [*by, "id_text"], ["before"]).withColumn("same", F.lit(True))
    by_key = last_by(previous.withColumnRenamed("id", "earlier"), [*by, "tagName", "name"], ["earlier"]).withColumn("named", F.lit(True))
    joined = current.withColumn("id_text", F.col("id").cast("string")).join(by_id, [*by, "id_text"], "left").join(by_key, [*by, "tagName", "name"], "left")
    state = F.when(F.col("same"), "existing").when(F.col("named"), "replaced").otherwise("new")
    delta = F.when(F.col("same"), clamped_delta(F.col("downloadCount"), F.col("before"))).otherwise(F.col("downloadCount"))
    return (
        joined.withColumn("trackingState", state).withColumn("downloadDelta", delta)
        .withColumn("previousAssetId", F.when(F.col("trackingState") == "replaced", F.col("earlier")))
        .drop("id_text", "same", "before", "named", "earlier")
    )


def clamped_delta(current: Column, previous: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), current - previous)


def totals(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """Release and asset counts, counters and increases; zeros for empty inputs."""
    zero = F.lit(0).cast("bigint")
    counted = releases.agg(F.count("*").alias("releaseCount"))
    summed = assets.agg(
        F.count("*").alias("assetCount"), F.coalesce(F.sum("downloadCount"), zero).alias("currentDownloads"), F.coalesce(F.sum("downloadDelta"), zero).alias("downloadIncrease")
    )
    return counted.join(summed, how="cross")  # one row each


def _state(df: DataFrame, kind: str, **known: Column) -> DataFrame:
    """Rows of ``schema.STATE``; columns that are neither given nor known are null."""
    has = {c: F.col(c) for c in df.columns} | known | {"kind": F.lit(kind)}
    return df.select(*[has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STATE.fields])


def previous_assets(rows: DataFrame) -> DataFrame:
    """The assets of one stored snapshot's flat rows, as :func:`match_states` takes them."""
    return rows.where("kind = 'asset'").select(F.col("release_nth").alias("r"), F.col("asset_nth").alias("a"), "tagName", "id", "name", "downloadCount")


def snapshot_rows(raw: DataFrame, previous: DataFrame | None, repository: str, captured_at: str, previous_date: str | None = None) -> DataFrame:
    """The snapshot of one capture as flat rows of ``schema.STATE``.

    ``captured_at`` is normalised ISO text; ``previous`` has the columns of :func:`previous_assets`.
    Assets sort by name and id as text, releases by tag, ties in input order; places count
    from 1 and are found by ranges, so neither a release nor the whole capture meets in one task.
    ``raw`` is read more than once, so it must give the same rows each time.
    """
    if "ordinal" not in raw.columns:
        raw = durable(raw.withColumn("ordinal", F.monotonically_increasing_id()))
    head = {"repository": F.lit(repository), "capturedAt": F.lit(captured_at), "date": F.lit(captured_at[:10]), "previousDate": F.lit(previous_date)}
    releases = flat_releases(raw)
    if previous is None:
        previous = previous_assets(raw.sparkSession.createDataFrame([], schema.STATE))
    ranked = durable(global_rank(releases.drop("assets"), [collated(F.col("tagName")), F.col("ordinal")], "release_nth"))
    # Written before it is dealt: the search for ranges would make the joins a second time.
    states = durable(match_states(flat_assets(releases), previous).withColumn("_one", F.lit(1).cast("long")))
    placed = running_sum(states, ["ordinal"], [collated(F.col("name")), collated(F.col("id").cast("string")), F.col("place")], "_one", "asset_nth").drop("tagName")
    named = ranked.select("ordinal", "release_nth", F.col("id").alias("releaseId"), "tagName", F.col("name").alias("releaseName"), "prerelease", "publishedAt", "releaseUrl")
    header = raw.sparkSession.range(1).drop("id")
    return _state(header, "snapshot", **head).unionByName(_state(named, "release", **head)).unionByName(_state(named.join(placed, "ordinal"), "asset", **head))


def rows_of(snapshots: DataFrame) -> DataFrame:
    """Stored snapshot documents as flat rows of ``schema.STATE``."""
    head = ["repository", "capturedAt", "date", "previousDate"]
    each = snapshots.select(*head, F.posexplode("releases").alias("r", "release"))
    release = {"release_nth": F.col("r") + 1, "tagName": F.col("release.tagName")} | {n: F.col(f"release.{f}") for n, f in (("releaseId", "id"), ("releaseName", "name"), ("prerelease", "prerelease"), ("publishedAt", "publishedAt"), ("releaseUrl", "releaseUrl"))}
    assets = each.select(*head, "r", "release", F.posexplode("release.assets").alias("a", "asset"))
    return (
        _state(snapshots.select(*head), "snapshot").unionByName(_state(each, "release", **release))
        .unionByName(_state(assets, "asset", **release, asset_nth=F.col("a") + 1, **{f: F.col(f"asset.{f}") for f in schema.ASSET.names}))
    )


def documents(rows: DataFrame) -> DataFrame:
    """One document of ``schema.SNAPSHOT`` per repository and date from flat rows; a document is one row, so it holds all its assets."""
    key = ["repository", "date"]
    listed = lambda nth, item: F.transform(F.array_sort(F.collect_list(F.struct(nth, item.alias("item")))), lambda x: x["item"])
    assets = rows.where("kind = 'asset'").groupBy(*key, "release_nth").agg(listed("asset_nth", F.struct(*schema.ASSET.names)).alias("assets"))
    none = F.array().cast(ArrayType(schema.ASSET))
    releases = rows.where("kind = 'release'").join(assets, [*key, "release_nth"], "left")
    release = F.struct(F.col("releaseId").alias("id"), "tagName", F.col("releaseName").alias("name"), "prerelease", "publishedAt", "releaseUrl", F.coalesce("assets", none).alias("assets"))
    bodies = releases.groupBy(*key).agg(listed("release_nth", release).alias("releases"))
    full = rows.where("kind = 'snapshot'").select(*key, "capturedAt", "previousDate").join(bodies, key, "left")
    full = full.withColumn("releases", F.coalesce("releases", F.array().cast(ArrayType(schema.RELEASE))))
    flat, zero = F.flatten(F.col("releases.assets")), F.lit(0).cast("bigint")

    def total(field: str) -> Column:
        return F.aggregate(F.transform(flat, lambda a: a[field]), zero, lambda s, x: s + x)

    sums = F.struct(
        F.size("releases").cast("bigint").alias("releaseCount"), F.size(flat).cast("bigint").alias("assetCount"),
        total("downloadCount").alias("currentDownloads"), total("downloadDelta").alias("downloadIncrease"),
    )
    return full.withColumn("totals", sums).withColumn("schemaVersion", F.lit(schema.SCHEMA_VERSION)).select(*schema.SNAPSHOT.names)


def build_snapshot(raw: DataFrame, previous: DataFrame | None, repository: str, captured_at: str) -> DataFrame:
    """The snapshot document of one capture, a single row of ``schema.SNAPSHOT``; ``previous`` holds one document at most."""
    if previous is None:
        return documents(snapshot_rows(raw, None, repository, captured_at))
    before = previous.agg(F.max("date")).first()[0]
    return documents(snapshot_rows(raw, snapshot_assets(previous), repository, captured_at, before))
