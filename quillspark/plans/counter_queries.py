"""Queries over the counter operators. The test tables stand in for releases: see each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema
from quillspark.functions import coerce
from quillspark.operators.counters import as_of, clamped_delta, first_by, match_states, published, snapshot_assets, totals
from quillspark.operators.durable import durable
from quillspark.operators.history import report_rows, unnested
from quillspark.operators.ranking import global_rank

FIRST_DAY = "2024-01-01"
TAG_NUMBERS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simulated_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters from events: tag = event type, asset = user, one snapshot per day.

    An asset's id changes with a ten-day epoch that begins on another day for each user,
    which plays re-uploads; assets are carried forward over days without events.
    """
    events = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("tagName"), F.col("user_id").cast("string").alias("name"), "user_id", (F.datediff(F.col("ts"), F.lit(FIRST_DAY)) + 1).alias("day")
    )
    daily = events.groupBy("tagName", "name", "user_id", "day").agg(F.count("*").alias("n"))
    last = events.agg(F.max("day").alias("last"))
    first = daily.groupBy("tagName", "name", "user_id").agg(F.min("day").alias("first")).join(F.broadcast(last))  # one row
    days = first.select("tagName", "name", "user_id", F.explode(F.sequence("first", "last")).alias("day"))
    running = Window.partitionBy("tagName", "user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counted = days.join(daily.drop("user_id"), ["tagName", "name", "day"], "left").withColumn("downloadCount", F.sum(F.coalesce("n", F.lit(0))).over(running))
    number = F.coalesce(*[F.when(F.col("tagName") == t, n) for t, n in TAG_NUMBERS.items()], F.lit(0))
    epoch = F.floor((F.col("day") - 1 + F.col("user_id") % 10) / 10)
    return counted.select("tagName", "name", "day", "downloadCount", (F.col("user_id") * 1000 + number * 100 + epoch).alias("id"))


_TAG_CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in TAG_NUMBERS.items()) + " ELSE 0 END"
SIMULATED = f"""
e AS (SELECT event_type AS tag, user_id, date_diff('day', DATE '{FIRST_DAY}', ts::DATE) + 1 AS day, {_TAG_CASE} AS tag_no FROM events),
f AS (SELECT tag, tag_no, user_id, min(day) AS first FROM e GROUP BY ALL),
d AS (SELECT f.*, unnest(range(first, (SELECT max(day) + 1 FROM e))) AS day FROM f),
n AS (SELECT tag, user_id, day, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT d.tag, d.user_id, d.day, user_id * 1000 + tag_no * 100 + ((d.day - 1 + user_id % 10) // 10) AS id,
        sum(coalesce(n.n, 0)) OVER (PARTITION BY d.tag, d.user_id ORDER BY d.day) AS count
      FROM d LEFT JOIN n USING (tag, user_id, day)),
l AS (SELECT *, lag(id) OVER w AS old_id, lag(count) OVER w AS old_count FROM c WINDOW w AS (PARTITION BY tag, user_id ORDER BY day)),
s AS (SELECT *, CASE WHEN old_id IS NULL THEN 'new' WHEN old_id = id THEN 'existing' ELSE 'replaced' END AS state,
        CASE WHEN old_id = id THEN greatest(count - old_count, 0) ELSE count END AS delta FROM l)
"""


def with_states(assets: DataFrame) -> DataFrame:
    """Every day's assets against the day before; written once, as it is read three times."""
    assets = durable(assets)
    earlier = assets.select((F.col("day") + 1).alias("day"), "tagName", "name", "id", "downloadCount", F.lit(0).alias("r"), F.lit(0).alias("a"))
    return match_states(assets, earlier, by=["day"])


def counter_delta_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = with_states(simulated_assets(spark, sf_dir))
    return states.groupBy("tagName", "trackingState").agg(F.count("*").alias("assets"), F.sum("downloadDelta").alias("increase")).withColumnsRenamed({"tagName": "tag", "trackingState": "state"})


def last_day(states: DataFrame) -> DataFrame:
    return states.join(F.broadcast(states.agg(F.max("day").alias("day"))), "day")  # one row


def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the last day's snapshot, a release being a tag."""
    assets = last_day(with_states(simulated_assets(spark, sf_dir)))
    return totals(assets.select("tagName").distinct(), assets)


def counter_totals_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a capture whose releases, orders of status P, are all drafts."""
    drafts = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit(True).alias("draft"), F.col("o_orderkey").alias("downloadCount"), F.col("o_orderkey").alias("downloadDelta"))
    return totals(published(drafts), published(drafts))


def asset_documents(states: DataFrame) -> DataFrame:
    """Snapshot documents that hold one asset each, so that no row grows with the table."""
    def filled(kind, **known):
        return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    asset = filled(schema.ASSET, **{c: F.col(c) for c in ("id", "name", "downloadCount", "downloadDelta", "trackingState", "previousAssetId")})
    release = filled(schema.RELEASE, tagName=F.col("tagName"), name=F.col("tagName"), assets=F.array(asset))
    return states.select(F.col("day").cast("string").alias("date"), F.col("day").cast("string").alias("capturedAt"), F.array(release).alias("releases"))


def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per calendar day with events, every third day left out."""
    days = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("downloads"), F.max("ts").alias("_t"))
    return days.where(F.dayofmonth(F.to_date("date")) % 3 != 0).select("date", coerce.iso_utc(F.col("_t").cast("timestamp")).alias("capturedAt"), "downloads")


def asof_previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [as_of(daily_snapshots(spark, sf_dir), day).select(F.lit(day).alias("capture_date"), F.col("date").alias("previous_date"), "downloads") for day in ("2024-01-01", "2024-01-07", "2024-01-10", "2024-02-15")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def counter_reset_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that fall on days divisible by seven: the delta is clamped at zero."""
    dipped = F.when(F.col("day") % 7 == 0, F.floor(F.col("downloadCount") / 2)).otherwise(F.col("downloadCount"))
    assets = simulated_assets(spark, sf_dir).withColumn("count", dipped)
    before = F.lag("count").over(Window.partitionBy("tagName", "name").orderBy("day"))
    deltas = assets.withColumn("delta", F.when(before.isNull(), F.col("count")).otherwise(clamped_delta(F.col("count"), before)))
    return deltas.groupBy("tagName").agg(F.sum("delta").alias("increase"), F.count_if(F.col("delta") == 0).alias("flat"), F.min("delta").alias("least")).withColumnRenamed("tagName", "tag")


def latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return first_by(events, ["date"], [F.col("ts").desc(), F.col("event_id")]).select("date", "event_id", "event_type", "user_id")


def published_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status P plays the draft flag, O a missing one."""
    orders = read(spark, sf_dir, "orders").withColumn("draft", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "P"))
    return published(orders).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def nested_unnest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a document whose release holds its lines; unnested again, orders without lines vanish."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    asset = lambda x: F.struct(*[{"id": x["l_linenumber"], "downloadCount": x["l_quantity"]}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.ASSET.fields])
    release = F.struct(F.col("o_custkey").cast("string").alias("tagName"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("prerelease"), F.transform(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), asset).alias("assets"))
    rows = unnested(orders.select(F.col("o_orderkey").cast("string").alias("date"), F.col("o_orderkey").cast("string").alias("capturedAt"), F.array(release).alias("releases")))
    return rows.select(F.col("release_tag").cast("bigint").alias("o_custkey"), F.col("date").cast("bigint").alias("o_orderkey"), F.col("asset_id").alias("l_linenumber"), F.col("download_count").alias("quantity"))


def flat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows and the flat assets of the last day's documents, side by side per asset."""
    documents = asset_documents(last_day(with_states(simulated_assets(spark, sf_dir))))
    flat = snapshot_assets(documents).select("tagName", "name", "id", "downloadCount")
    rows = documents.select(F.posexplode("releases").alias("_r", "release")).select(F.explode("release.assets").alias("a"), "release.tagName")
    deltas = rows.select("tagName", F.col("a.id").alias("id"), F.col("a.downloadDelta").alias("delta"), F.col("a.previousAssetId").alias("earlier"))
    return flat.join(deltas, ["tagName", "id"])


def locale_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return global_rank(names, [coerce.collated(F.col("p_name")), F.col("p_name")], "place")


_LITERALS = ["12", " 12 ", "", "12d", "1e3", "Infinity", "NaN", "-3", "2.9", "0007", ".5", "5.", "+4", "1e-2", "--1", "0x10", "0B101", "1e30"]


def nonneg_int_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event takes one of the literals by its number."""
    raw = F.get(F.array(*[F.lit(x) for x in _LITERALS]), (F.col("event_id") % len(_LITERALS)).cast("int"))
    rows = read(spark, sf_dir, "events").select(raw.alias("raw")).withColumn("value", coerce.non_negative_integer(F.col("raw")))
    return rows.groupBy("raw", "value").agg(F.count("*").alias("n"))


def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", coerce.name_or(segment, coerce.text(F.col("c_name"))).alias("shown"), coerce.text(segment).alias("plain"))


def csv_cell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit('"q",'))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", coerce.csv_cell(made).alias("cell"))


def markdown_cell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", coerce.markdown_cell(F.col("text")).alias("cell"))


def iso_date_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = read(spark, sf_dir, "events").select("event_id", coerce.iso_utc(F.col("ts").cast("timestamp")).alias("iso"))
    return iso.select("event_id", "iso", coerce.iso_date(F.col("iso")).alias("date"))


def link_header_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a>; rel=\"prev\", <"), "url", F.lit('>;  REL="next", <z>; rel="last"'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<"), "url", F.lit('>; rel="last"')))
    return read(spark, sf_dir, "pages").select("page_id", coerce.next_link(header).alias("next_url"))


def page_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages appended without any check for repeats: the overlap counts twice."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    pages = orders.where("o_orderkey % 3 = 0").unionByName(orders.where("o_orderkey % 2 = 0"))
    return pages.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(parsed["k"].alias("k"), F.lit(None).cast("string").alias("missing")), {"ignoreNullFields": "false"}).alias("document"))
    return rows.select("event_id", "document", F.from_json("document", "k bigint")["k"].alias("k"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's table lines for the last day."""
    return report_rows(asset_documents(last_day(with_states(simulated_assets(spark, sf_dir)))))


QUERIES = {f.__name__: f for f in (
    counter_delta_states, counter_totals, counter_totals_empty, asof_previous_snapshot, counter_reset_clamp, latest_per_day, published_filter,
    nested_unnest_history, locale_sort_rank, nonneg_int_coerce, name_fallback, csv_cell_escape, markdown_cell_escape, iso_date_utc,
    link_header_next, page_append, json_roundtrip, report_lines, flat_history,
)}

_VALUES = ", ".join(f"({k}, '{x}')" for k, x in enumerate(_LITERALS))
_SNAPSHOTS = "g AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS downloads FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1)"

ORACLE_SQL = {
    "counter_delta_states": f"WITH {SIMULATED} SELECT tag, state, count(*) AS assets, sum(delta)::BIGINT AS increase FROM s GROUP BY ALL",
    "counter_totals": f"WITH {SIMULATED} SELECT count(DISTINCT tag) AS releaseCount, count(*) AS assetCount, sum(count)::BIGINT AS currentDownloads, sum(delta)::BIGINT AS downloadIncrease FROM s WHERE day = (SELECT max(day) FROM s)",
    "counter_totals_empty": "SELECT count(*) AS releaseCount, count(*) AS assetCount, coalesce(sum(o_orderkey), 0)::BIGINT AS currentDownloads, coalesce(sum(o_orderkey), 0)::BIGINT AS downloadIncrease FROM (SELECT *, o_orderstatus = 'P' AS draft FROM orders) WHERE o_orderstatus = 'P' AND NOT draft",
    "flat_history": f"WITH {SIMULATED} SELECT tag AS tagName, user_id::VARCHAR AS name, id::BIGINT AS id, count::BIGINT AS downloadCount, delta::BIGINT AS delta, CASE WHEN state = 'replaced' THEN old_id::BIGINT END AS earlier FROM s WHERE day = (SELECT max(day) FROM s)",
    "asof_previous_snapshot": f"WITH {_SNAPSHOTS}, w AS (SELECT unnest(['2024-01-01', '2024-01-07', '2024-01-10', '2024-02-15']) AS capture_date) SELECT capture_date, max(g.date) AS previous_date, arg_max(downloads, g.date) AS downloads FROM w JOIN g ON g.date < capture_date GROUP BY capture_date",
    "counter_reset_clamp": f"WITH {SIMULATED}, x AS (SELECT tag, user_id, day, CASE WHEN day % 7 = 0 THEN count::BIGINT // 2 ELSE count::BIGINT END AS count FROM c), y AS (SELECT tag, CASE WHEN lag(count) OVER w IS NULL THEN count ELSE greatest(0, count - lag(count) OVER w) END AS delta FROM x WINDOW w AS (PARTITION BY tag, user_id ORDER BY day)) SELECT tag, sum(delta)::BIGINT AS increase, count(*) FILTER (delta = 0) AS flat, min(delta)::BIGINT AS least FROM y GROUP BY tag",
    "latest_per_day": "SELECT date, event_id, event_type, user_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, event_type, user_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1",
    "published_filter": "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "nested_unnest_history": "SELECT o_custkey, o_orderkey, l_linenumber, l_quantity::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "locale_sort_rank": "SELECT p_name, n, row_number() OVER (ORDER BY p_name COLLATE en) AS place FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)",
    "nonneg_int_coerce": f"WITH v(k, raw) AS (VALUES {_VALUES}), x AS (SELECT raw, CASE WHEN regexp_full_match(raw, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN CASE WHEN trim(raw)::DOUBLE >= 9.3e18 THEN 9223372036854775807 ELSE greatest(trunc(trim(raw)::DOUBLE), 0)::BIGINT END WHEN raw = '0x10' THEN 16 WHEN raw = '0B101' THEN 5 ELSE 0 END AS value FROM events JOIN v ON event_id % {len(_LITERALS)} = k) SELECT raw, value, count(*) AS n FROM x GROUP BY ALL",
    "name_fallback": "WITH x AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer) SELECT c_custkey, CASE WHEN s IS NULL OR s = '' THEN c_name ELSE s END AS shown, coalesce(s, '') AS plain FROM x",
    "csv_cell_escape": "WITH x AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN text || '\"q\",' ELSE text END, '') AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, '\"') OR contains(t, ',') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END AS cell FROM x",
    "markdown_cell_escape": "SELECT doc_id, replace(replace(replace(coalesce(text, ''), '|', '\\|'), chr(13) || chr(10), ' '), chr(10), ' ') AS cell FROM documents",
    "iso_date_utc": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%d') AS date FROM events",
    "link_header_next": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS next_url FROM pages",
    "page_append": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1",
    "json_roundtrip": "SELECT event_id, '{\"k\":' || (props::JSON->>'k') || ',\"missing\":null}' AS document, (props::JSON->>'k')::BIGINT AS k FROM events",
    "report_lines": f"WITH {SIMULATED} SELECT '| ' || tag || ' | ' || user_id || ' | ' || count::BIGINT || ' | +' || delta::BIGINT || ' | ' || state || ' |' AS line FROM s WHERE day = (SELECT max(day) FROM s)",
}
