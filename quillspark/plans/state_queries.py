"""Queries over stored state: as-of joins, snapshots and their order, pages, documents and the history file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions.coerce import collated
from quillspark.operators.asof import asof_join
from quillspark.operators.counters import flat_assets, flat_releases, previous_assets, snapshot_rows
from quillspark.operators.durable import durable, scratch_root
from quillspark.operators.ranking import global_rank, running_sum
from quillspark.plans.counter_queries import FIRST_DAY, SIMULATED, daily_snapshots, read, simulated_assets, with_states
from quillspark.sources.snapshots import read_releases, read_rows, write_documents, write_history_file
from quillspark.sources.state import earlier_day, read_day, read_state, write_days
from quillspark.streaming.daily import stream_captures, stream_state

CLOCK = "T00:00:00.000Z"


def scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view before it; purchases without one keep nulls."""
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_join(bought, seen, {"user_id": "user_id"}, "ts", "ts", {"view_id": "event_id", "viewed": "value"}, tie=["event_id"]).select("event_id", "view_id", "viewed")


def asof_capture_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures against all snapshots at once: per event the newest snapshot of a strictly earlier day."""
    captures = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("capture_date"))
    return asof_join(captures, daily_snapshots(spark, sf_dir), {}, "capture_date", "date", {"previous_date": "date", "downloads": "downloads"})


def raw_orders(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """Orders as raw releases, tagged by customer, their lines as assets; tags repeat, and so do names under a tag.

    The former capture leaves out each fifth order; in the current one each third line
    number is uploaded anew, and counters rise for even orders and fall for odd ones.
    """
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    renewed = F.when(F.lit(current) & (line % 3 == 0), 1_000_000_000).otherwise(0)
    count = F.col("l_quantity") + (F.when(key % 2 == 0, 5).otherwise(-3) if current else F.lit(0))
    part = F.col("l_partkey")
    asset = F.struct(
        (part * 10 + line + renewed).alias("id"), F.concat(F.lit("Part "), (part % 7).cast("string")).alias("name"), F.lit("1").alias("size"), count.cast("string").alias("download_count"),
        F.lit(None).cast("string").alias("updated_at"), F.lit(None).cast("string").alias("browser_download_url"),
    )
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(line, part, F.col("l_suppkey"), F.col("l_extendedprice"), asset.alias("asset")))).alias("lines"))
    orders = read(spark, sf_dir, "orders")
    orders = orders if current else orders.where("o_orderkey % 5 <> 0")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.lit(None).cast("string")
    return joined.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("tag "), (F.col("o_custkey") % 40).cast("string")).alias("tag_name"), none.alias("name"), (F.col("o_orderstatus") == "P").alias("draft"), F.lit(None).cast("boolean").alias("prerelease"),
        none.alias("published_at"), none.alias("html_url"), F.transform("lines", lambda x: x["asset"]).alias("assets"), F.col("o_orderkey").alias("ordinal"),
    )


def snapshot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored places of releases and assets, compared by position."""
    rows = snapshot_rows(durable(raw_orders(spark, sf_dir, False)), None, "o/r", f"2024-01-01{CLOCK}").where("kind <> 'snapshot'")
    return rows.select("kind", "release_nth", "asset_nth", "tagName", "releaseId", "name", "id", "downloadCount")


def repeated_keys_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures by way of the state table; keys repeat, and the last of them in stored order is the earlier one."""
    table = scratch(spark)
    write_days(snapshot_rows(durable(raw_orders(spark, sf_dir, False)), None, "o/r", f"2024-01-01{CLOCK}"), table)
    before = earlier_day(spark, table, "2024-01-02")
    rows = snapshot_rows(durable(raw_orders(spark, sf_dir, True)), previous_assets(read_day(spark, table, before)), "o/r", f"2024-01-02{CLOCK}", before)
    return rows.where("kind = 'asset'").select("releaseId", "previousDate", "id", "name", "downloadCount", "downloadDelta", "trackingState", "previousAssetId")


def page_append_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved API pages of a hundred, each repeating the ten before it: every repeat is kept, drafts go, unusable counts are 0."""
    key = F.col("o_orderkey")
    count = F.when(key % 4 == 0, F.lit('"0x10"')).when(key % 4 == 1, F.lit("-3")).when(key % 4 == 2, F.lit("7.9")).otherwise(F.lit("null"))
    assets = F.when(key % 6 == 0, F.lit("null")).otherwise(F.concat(F.lit('[{"id":'), key, F.lit(',"name":null,"download_count":'), count, F.lit("}]")))
    body = F.concat(F.lit('{"id":'), key, F.lit(',"tag_name":"v'), key % 1000, F.lit('","draft":'), (F.col("o_orderstatus") == "P").cast("string"), F.lit(',"assets":'), assets, F.lit("}"))
    page = F.floor(key / 100)
    listed = read(spark, sf_dir, "orders").select(key.alias("k"), body.alias("body"), F.explode(F.when(key % 100 >= 90, F.array(page, page + 1)).otherwise(F.array(page))).alias("page"))
    folder = scratch(spark)
    pages = listed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "body"))).alias("rows"))  # 110 at most
    pages.select(F.concat(F.lit("["), F.array_join("rows.body", ","), F.lit("]")).alias("value")).write.text(folder)
    return flat_assets(flat_releases(read_releases(spark, folder, lines=True))).select("tagName", "id", "name", "sizeBytes", "downloadCount")


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulated assets of every day as flat state rows, a release being a tag."""
    states = durable(with_states(simulated_assets(spark, sf_dir)).withColumn("_one", F.lit(1).cast("long")))  # read twice, and by the search for ranges
    placed = running_sum(states, ["day", "tagName"], [collated(F.col("name")), F.col("id")], "_one", "asset_nth")
    day = lambda n: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")), "yyyy-MM-dd")
    days = durable(states.groupBy("day", "tagName").agg(F.count("*").alias("n")))
    tags = global_rank(days.select("tagName").distinct(), [collated(F.col("tagName"))], "nth")
    per_day = running_sum(days.join(tags, "tagName").withColumn("_one", F.lit(1).cast("long")), ["day"], [F.col("nth")], "_one", "release_nth").select("day", "tagName", "release_nth")
    previous = days.groupBy("day").agg(F.lit(1).alias("n"))
    dated = asof_join(previous, days, {}, "day", "day", {"earlier": "day"})
    head = {"repository": F.lit("o/r"), "capturedAt": F.concat(day(F.col("day") - 1), F.lit(CLOCK)), "date": day(F.col("day") - 1), "previousDate": day(F.col("earlier") - 1), "releaseName": F.col("tagName"), "prerelease": F.lit(False)}

    def shaped(rows: DataFrame, kind: str) -> DataFrame:
        known = {c: F.col(c) for c in rows.columns} | {k: v for k, v in head.items() if kind != "snapshot" or k not in ("releaseName", "prerelease")} | {"kind": F.lit(kind)}
        return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STATE.fields])

    releases = per_day.join(dated, "day")
    return shaped(dated.drop("n"), "snapshot").unionByName(shaped(releases, "release")).unionByName(shaped(placed.join(releases, ["day", "tagName"]), "asset"))


def documents_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document per day, written and read again: places, previous day, counts and states of all assets."""
    folder = scratch(spark)
    write_documents(durable(state_rows(spark, sf_dir)), folder)
    rows = read_rows(spark, folder).where("kind = 'asset'")
    return rows.select("date", "previousDate", "release_nth", "asset_nth", "tagName", "name", "id", "downloadCount", "downloadDelta", "trackingState", "previousAssetId")


def history_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the one ordered CSV file, from a state table to which days were written twice."""
    table, folder = scratch(spark), scratch(spark)
    rows = durable(state_rows(spark, sf_dir))
    write_days(rows.withColumn("downloadCount", F.lit(-1).cast("long")), table)
    write_days(rows, table)
    write_history_file(read_state(spark, table), folder, "history.csv")
    return spark.read.text(f"{folder}/history.csv").withColumnRenamed("value", "line")


def keyed_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag as a repository whose days arrive as JSON captures: the stream's states and deltas by day."""
    assets = simulated_assets(spark, sf_dir)
    asset = F.struct("id", "name", F.lit(None).cast("string").alias("size"), F.col("downloadCount").alias("download_count"))
    captures = assets.groupBy("tagName", "day").agg(F.collect_list(asset).alias("assets"))  # a capture is one document
    time = F.concat(F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("day") - 1).cast("int")), "yyyy-MM-dd"), F.lit("T12:00:00Z"))
    release = F.struct(F.lit(1).alias("id"), F.col("tagName").alias("tag_name"), "assets")
    inbox, out = scratch(spark), scratch(spark)
    captures.select(F.to_json(F.struct(F.col("tagName").alias("repository"), time.alias("capturedAt"), F.array(release).alias("releases"))).alias("value")).write.text(inbox)
    stream_captures(spark, inbox, out, "o/r", f"{out}/checkpoint", lines=True, views=False).awaitTermination()
    rows = stream_state(spark, out).where("kind = 'asset'")
    return rows.groupBy("date", F.col("repository").alias("tag"), F.col("trackingState").alias("state")).agg(F.count("*").alias("assets"), F.sum("downloadDelta").alias("increase"))


QUERIES = {f.__name__: f for f in (asof_last_view, asof_capture_days, snapshot_order, repeated_keys_snapshot, page_append_repeats, documents_roundtrip, history_file, keyed_stream_states)}


def _raw_sql(current: bool) -> str:
    count = "l_quantity" + (" + CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE -3 END" if current else "")
    renewed = " + CASE WHEN l_linenumber % 3 = 0 THEN 1000000000 ELSE 0 END" if current else ""
    rest = "" if current else " AND o_orderkey % 5 <> 0"
    return f"""r AS (SELECT o_orderkey AS release_id, 'tag ' || o_custkey % 40 AS tag FROM orders WHERE o_orderstatus <> 'P'{rest}),
rn AS (SELECT *, row_number() OVER (ORDER BY tag COLLATE en, release_id) AS release_nth FROM r),
a AS (SELECT release_id, tag, release_nth, l_partkey * 10 + l_linenumber{renewed} AS id, 'Part ' || l_partkey % 7 AS name, greatest(trunc({count}), 0)::BIGINT AS count,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey * 10 + l_linenumber{renewed}) AS place FROM rn JOIN lineitem ON l_orderkey = release_id),
an AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY name COLLATE en, id::VARCHAR COLLATE en, place) AS asset_nth FROM a)"""


_DAYS = f"""{SIMULATED}, days AS (SELECT day, tag, row_number() OVER (PARTITION BY day ORDER BY tag COLLATE en) AS release_nth FROM s GROUP BY day, tag),
earlier AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM s)),
flat AS (SELECT strftime(DATE '{FIRST_DAY}' + (s.day - 1)::INT, '%Y-%m-%d') AS date, strftime(DATE '{FIRST_DAY}' + (before - 1)::INT, '%Y-%m-%d') AS previousDate, release_nth,
  row_number() OVER (PARTITION BY s.day, s.tag ORDER BY user_id::VARCHAR COLLATE en, id) AS asset_nth, s.tag AS tagName, user_id::VARCHAR AS name, id::BIGINT AS id, count::BIGINT AS downloadCount, delta::BIGINT AS downloadDelta,
  state AS trackingState, CASE WHEN state = 'replaced' THEN old_id::BIGINT END AS previousAssetId FROM s JOIN days USING (day, tag) JOIN earlier USING (day))"""
_CURRENT, _FORMER = _raw_sql(True), _raw_sql(False)
_STORED = "(release_nth << 32) + asset_nth"

ORACLE_SQL = {
    "asof_last_view": "SELECT p.event_id, v.event_id AS view_id, v.value AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts",
    "asof_capture_days": "WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS downloads FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1), c AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS capture_date FROM events) SELECT event_id, capture_date, g.date AS previous_date, downloads FROM c ASOF LEFT JOIN g ON c.capture_date > g.date",
    "snapshot_order": f"WITH {_FORMER} SELECT 'release' AS kind, release_nth, NULL::BIGINT AS asset_nth, tag AS \"tagName\", release_id AS \"releaseId\", NULL AS name, NULL::BIGINT AS id, NULL::BIGINT AS \"downloadCount\" FROM rn UNION ALL SELECT 'asset', release_nth, asset_nth, tag, release_id, name, id, count FROM an",
    "repeated_keys_snapshot": f"""WITH old AS (WITH {_FORMER} SELECT * FROM an), new AS (WITH {_CURRENT} SELECT * FROM an),
by_id AS (SELECT id, arg_max(count, {_STORED}) AS before FROM old GROUP BY id), by_name AS (SELECT tag, name, arg_max(id, {_STORED}) AS earlier FROM old GROUP BY tag, name)
SELECT release_id AS "releaseId", '2024-01-01' AS "previousDate", new.id, new.name, count AS "downloadCount", CASE WHEN before IS NOT NULL THEN greatest(count - before, 0) ELSE count END AS "downloadDelta",
  CASE WHEN before IS NOT NULL THEN 'existing' WHEN earlier IS NOT NULL THEN 'replaced' ELSE 'new' END AS "trackingState", CASE WHEN before IS NULL THEN earlier END AS "previousAssetId"
FROM new LEFT JOIN by_id USING (id) LEFT JOIN by_name ON new.tag = by_name.tag AND new.name = by_name.name""",
    "page_append_repeats": "SELECT 'v' || o_orderkey % 1000 AS \"tagName\", o_orderkey AS id, '' AS name, 0::BIGINT AS \"sizeBytes\", CASE o_orderkey % 4 WHEN 0 THEN 16 WHEN 2 THEN 7 ELSE 0 END::BIGINT AS \"downloadCount\" FROM orders, (SELECT unnest([0, 1]) AS again) WHERE o_orderstatus <> 'P' AND o_orderkey % 6 <> 0 AND (again = 0 OR o_orderkey % 100 >= 90)",
    "documents_roundtrip": f'WITH {_DAYS} SELECT date, previousDate AS "previousDate", release_nth, asset_nth, tagName AS "tagName", name, id, downloadCount AS "downloadCount", downloadDelta AS "downloadDelta", trackingState AS "trackingState", previousAssetId AS "previousAssetId" FROM flat',
    "history_file": f"WITH {_DAYS} SELECT 'date,captured_at,release_tag,release_name,is_prerelease,asset_id,asset_name,size_bytes,download_count,download_delta,tracking_state' AS line UNION ALL SELECT date || ',' || date || '{CLOCK},' || tagName || ',' || tagName || ',false,' || id || ',' || name || ',,' || downloadCount || ',' || downloadDelta || ',' || trackingState FROM flat",
    "keyed_stream_states": f"WITH {SIMULATED} SELECT strftime(DATE '{FIRST_DAY}' + (day - 1)::INT, '%Y-%m-%d') AS date, tag, state, count(*) AS assets, sum(delta)::BIGINT AS increase FROM s GROUP BY ALL",
}
