"""The daily job as a stream with keyed state: each repository's captures are compared with its own earlier days.

The state of a repository is dealt into ``SHARDS`` parts, each a map from days to what a comparison
needs of them, held by the state store, so it outlives executors and is not read whole: a
capture reads the names of days, the newest earlier day and writes its own. An asset goes to the
part of its id, which knows earlier counts, and to the part of its tag and name, which knows
earlier ids; each part sees every capture, so all take the same days. The answers of both parts
are joined in the batch. No task holds all assets of a repository. A change of ``SHARDS`` needs a new
checkpoint, which takes all captures up again. Captures are taken in order of time within a batch, the last of a day counts, and
a day that comes again replaces its rows. A late day is compared with the newest earlier
one and leaves later days as they are, as in the batch job.

Days older than ``retain_days`` before a repository's newest day leave the state; a capture
that is older still cannot be compared and is kept as a row of status ``late`` for the batch job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from quillspark import schema
from quillspark.functions.coerce import collated, flag, iso_date, iso_utc, name_or, non_negative_integer, text
from quillspark.sources.snapshots import write_documents, write_history_file
from quillspark.sources.state import read_state, write_days

CAPTURE = StructType([StructField("repository", StringType()), StructField("capturedAt", StringType()), StructField("releases", ArrayType(schema.RAW_RELEASES))])
STREAM = StructType([StructField("status", StringType()), *schema.STATE.fields])
#: What the parts say (names without a leading underscore, which Spark would lose on the way to Python): role 0 has an asset's row and what is known of its id, role 1 the earlier id of its tag and name, if any.
PARTS = StructType([*STREAM.fields, StructField("token", DoubleType()), StructField("by_name", BooleanType())])
SHARDS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETAIN_DAYS = 400


def _sorted(items: Column, *keys) -> Column:
    """An array's items by collated keys, ties in the array's order."""
    return F.array_sort(F.transform(items, lambda x, k: F.struct(*[collated(key(x)).alias(f"c{n}") for n, key in enumerate(keys)], k.alias("k"), x.alias("item"))))


def capture_rows(captures: DataFrame) -> DataFrame:
    """Captures as flat rows of ``schema.STATE`` in stored order, not yet compared: a map over rows, without a shuffle.

    Text without a zone is UTC; a capture without a readable time fails.
    """
    time = F.coalesce(iso_utc(F.try_to_timestamp("capturedAt")), F.raise_error(F.lit("a valid capture time is required")).cast("string"))
    extra = [c for c in captures.columns if c not in CAPTURE.names]
    none = F.array().cast(ArrayType(schema.RAW_RELEASES))
    kept = F.filter(F.coalesce("releases", none), lambda r: ~flag(r["draft"]))
    timed = captures.select(F.coalesce("repository", F.lit("")).alias("repository"), time.alias("capturedAt"), *extra, _sorted(kept, lambda r: text(r["tag_name"])).alias("listed"))
    r = F.col("release")
    head = ["repository", "capturedAt", *extra]
    each = timed.select(*head, F.posexplode_outer("listed").alias("_r", "x")).select(*head, (F.col("_r") + 1).alias("release_nth"), F.col("x.item").alias("release"))
    tag = text(r["tag_name"])
    no_assets = F.array().cast(ArrayType(schema.RAW_ASSET))
    assets = F.coalesce(r["assets"], no_assets)
    listed = _sorted(assets, lambda a: text(a["name"]), lambda a: a["id"].cast("string"))
    # One row more than assets stands for the release itself, and one more before the first release for the snapshot.
    marker = F.array(F.lit(None).cast(listed_type(each, listed)))
    both = F.when(F.col("release_nth").isNull(), marker).otherwise(F.concat(F.when(F.col("release_nth") == 1, F.concat(marker, marker)).otherwise(marker), listed))
    rows = each.select("*", F.posexplode(both).alias("_a", "y"))
    spare = F.when(F.col("release_nth").isNull() | (F.col("release_nth") > 1), 1).otherwise(2)
    kind = F.when(F.col("y").isNotNull(), "asset").when(F.col("release_nth").isNull() | ((F.col("release_nth") == 1) & (F.col("_a") == 0)), "snapshot").otherwise("release")
    a, is_asset, inside = F.col("y.item"), F.col("y").isNotNull(), kind != "snapshot"
    known = {
        "repository": F.col("repository"), "capturedAt": F.col("capturedAt"), "date": iso_date(F.col("capturedAt")), "kind": kind, "release_nth": F.when(inside, F.col("release_nth")),
        "asset_nth": F.when(is_asset, F.col("_a") - spare + 1), "releaseId": F.when(inside, r["id"]), "tagName": F.when(inside, tag), "releaseName": F.when(inside, name_or(r["name"], tag)), "prerelease": F.when(inside, flag(r["prerelease"])),
        "publishedAt": F.when(inside, r["published_at"]), "releaseUrl": F.when(inside, r["html_url"]), "id": a["id"], "name": F.when(is_asset, text(a["name"])), "sizeBytes": F.when(is_asset, non_negative_integer(a["size"])),
        "downloadCount": F.when(is_asset, non_negative_integer(a["download_count"])), "updatedAt": a["updated_at"], "downloadUrl": a["browser_download_url"],
    }
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STATE.fields], *extra)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of captures with ``shard`` and ``by_name``: assets go to two parts, snapshots to all, releases to the first."""
    kind, part = F.col("kind"), lambda *by: F.pmod(F.xxhash64(*by), F.lit(SHARDS)).cast("int")
    place = lambda shard, named: F.struct(shard.alias("shard"), F.lit(named).alias("named"))
    places = (
        F.when(kind == "asset", F.array(place(part("id"), False), place(part("tagName", "name"), True)))
        .when(kind == "snapshot", F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), lambda k: place(k, False)))
        .otherwise(F.array(place(F.lit(0), False)))
    )
    asked = {"repository", "capturedAt", "date", "kind", "release_nth", "asset_nth", "id", "tagName", "name"}
    each = rows.withColumn("_place", F.explode(places))
    columns = [F.col(f.name) if f.name in asked else F.when(~F.col("_place.named"), F.col(f.name)).alias(f.name) for f in schema.STATE.fields]
    return each.select(*columns, "token", F.col("_place.shard").alias("shard"), F.col("_place.named").alias("by_name"))


def listed_type(df: DataFrame, listed: Column):
    return df.select(listed.alias("x")).schema[0].dataType.elementType


class Chain(StatefulProcessor):
    """The days of one part of a repository, and the comparison of its captures with them."""

    def __init__(self, retain_days: int):
        self.retain_days = retain_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "date string", "assets string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        table = pd.concat(rows).sort_values(["capturedAt", "release_nth", "asset_nth"], kind="stable", na_position="first")
        known = {k[0] for k in self.days.keys()}
        held: tuple[str | None, list] = (None, [])  # the day written last
        for day, captured in table.groupby("date", sort=True):
            last = captured[captured["capturedAt"] == captured["capturedAt"].max()]
            shown = last if key[1] == 0 else last[last["kind"] != "snapshot"]
            if known and day < self.oldest(max(known)):
                if key[1] == 0:
                    yield last[last["kind"] == "snapshot"].assign(status="late")[PARTS.names]
                continue
            before = max((d for d in known if d < day), default=None)
            earlier = [[[], []], [[], [], []]] if before is None else held[1] if before == held[0] else json.loads(self.days.getValue((before,))[0])
            if len(shown):
                yield self.compared(shown, before, *earlier)
            assets = last[last["kind"] == "asset"]
            own, named = assets[~assets["by_name"].astype(bool)], assets[assets["by_name"].astype(bool)]
            held = day, [[x[c].tolist() for c in names] for x, names in ((own, ("id", "downloadCount")), (named, ("tagName", "name", "id")))]
            self.days.updateValue((day,), (json.dumps(held[1]),))
            known.add(day)
            for old in [d for d in known if d < self.oldest(max(known))]:
                self.days.removeKey((old,))
                known.discard(old)

    def oldest(self, newest: str) -> str:
        return (date.fromisoformat(newest) - timedelta(days=self.retain_days)).isoformat()

    def compared(self, shown: pd.DataFrame, before: str | None, own: list, names: list) -> pd.DataFrame:
        same = {i: c for i, c in zip(*own) if i is not None and i == i}  # of equal ids the last in stored order
        named = {(tag, name): i for tag, name, i in zip(*names)}
        states, deltas, earlier, kept = [], [], [], []
        for kind, asked, i, tag, name, count in shown[["kind", "by_name", "id", "tagName", "name", "downloadCount"]].itertuples(index=False):
            own_row = kind == "asset" and not asked
            state = "existing" if own_row and i in same else None
            states.append(state)
            deltas.append(None if not own_row else max(0, int(count) - int(same[i])) if state else int(count))
            old = named.get((tag, name)) if asked else None
            earlier.append(None if old is None or old != old else int(old))
            kept.append(not asked or (tag, name) in named)
        out = shown.assign(status="day", previousDate=before, trackingState=states)
        out["downloadDelta"], out["previousAssetId"] = pd.array(deltas, "Int64"), pd.array(earlier, "Int64")
        return out.loc[kept, PARTS.names]

    def close(self) -> None:
        pass


def compare_stream(captures: DataFrame, retain_days: int = RETAIN_DAYS) -> DataFrame:
    """``PARTS`` rows of a stream of captures, compared with the repository's newest earlier day; :func:`settled` joins those of a batch."""
    rows = dealt(capture_rows(captures.withColumn("token", F.rand())))  # tells captures of one time apart
    return rows.groupBy("repository", "shard").transformWithStateInPandas(Chain(retain_days), PARTS, "Append", "None")


def settled(batch: DataFrame) -> DataFrame:
    """``STREAM`` rows of a batch: an asset whose id is not known is a replacement where its tag and name are."""
    place = ["repository", "capturedAt", "token", "release_nth", "asset_nth"]
    named = batch.where("by_name").select(*place, F.col("previousAssetId").alias("_earlier"), F.lit(True).alias("_met"))
    rows = batch.where("not by_name").join(named, place, "left")
    replaced = (F.col("kind") == "asset") & F.col("trackingState").isNull() & F.col("_met")
    state = F.when(F.col("kind") == "asset", F.coalesce("trackingState", F.when(F.col("_met"), "replaced").otherwise("new")))
    return rows.withColumn("previousAssetId", F.when(replaced, F.col("_earlier"))).withColumn("trackingState", state).select(STREAM.names)


def stream_captures(
    spark: SparkSession, inbox: str, output_dir: str, repository: str, checkpoint: str, lines: bool = False, retain_days: int = RETAIN_DAYS, views: bool = True,
) -> StreamingQuery:
    """Take up all captures waiting in ``inbox`` and stop; the next start goes on from there.

    A capture is a JSON document ``{"repository": ..., "capturedAt": ..., "releases": [...]}``, one a
    file or, with ``lines``, one a line; ``repository`` is for captures that name none. A batch
    replaces the partitions of its days and repositories in ``<output_dir>/state``, so a
    replay changes nothing; ``views`` writes the documents of its days and the history anew.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    captures = spark.readStream.schema(CAPTURE).option("multiLine", not lines).option("mode", "FAILFAST").json(inbox)
    named = captures.withColumn("repository", F.coalesce("repository", F.lit(repository)))
    table = f"{output_dir}/state"

    def take(batch: DataFrame, _: int) -> None:
        parts = batch.persist()
        batch = settled(parts).persist()
        write_days(batch, table, ("status", "date", "repository"))
        if views:
            whole, days = stream_state(batch.sparkSession, output_dir), batch.where("status = 'day'").select("date").distinct()
            write_documents(whole.join(days, "date", "left_semi").select(whole.columns), f"{output_dir}/snapshots")
            write_history_file(whole, output_dir, "release-downloads.csv")
        batch.unpersist()
        parts.unpersist()

    return compare_stream(named, retain_days).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_state(spark: SparkSession, output_dir: str, status: str = "day") -> DataFrame:
    """The flat rows that the stream has written, by status: compared days, or captures that were too late for it."""
    return read_state(spark, f"{output_dir}/state", status)
