"""Snapshot semantics: the reference scenarios and the cases they leave out."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark import schema
from quillspark.functions import coerce
from quillspark.operators.counters import as_of, build_snapshot, flat_assets, flat_releases, totals, match_states, snapshot_assets
from quillspark.operators.durable import durable
from quillspark.operators.history import history, latest_per_date
from quillspark.plans import job
from quillspark.sources import releases_api
from quillspark.sources.snapshots import history_csv, pretty, read_snapshots, report, write_history

RAW = StructType([*schema.RAW_RELEASES.fields, StructField("ordinal", LongType())])


def asset(id, name, downloads, size="1024"):
    return (id, name, str(size), None if downloads is None else str(downloads), "2026-07-12T00:00:00Z", f"https://x/{name}")


def release(id, tag, assets=(), name="?", draft=False, prerelease=False):
    return (id, tag, tag if name == "?" else name, draft, prerelease, "2026-07-12T00:00:00Z", f"https://x/{tag}", assets if assets is None else list(assets))


def raw(spark, *releases):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(releases)], RAW)


def snap(spark, moment, *releases, previous=None):
    return durable(build_snapshot(raw(spark, *releases), previous, "o/r", job.normalised_time(moment)))


def assets_of(snapshot):
    return {a.id: a for r in snapshot.first().releases for a in r.assets}


def test_drafts_are_dropped_and_totals_add_up(spark):
    s = snap(
        spark, "2026-07-12T16:17:00Z",
        release(2, "v2", [asset(22, "app-x64.zip", 2), asset(21, "app-arm64.zip", 6)], prerelease=True),
        release(1, "v1", [asset(11, "a", 99)], draft=True),
    ).first()
    assert (s.date, s.schemaVersion, s.previousDate) == ("2026-07-12", 1, None)
    assert s.totals == Row(releaseCount=1, assetCount=2, currentDownloads=8, downloadIncrease=8)
    assert [(a.name, a.trackingState) for a in s.releases[0].assets] == [("app-arm64.zip", "new"), ("app-x64.zip", "new")]


def test_states_and_deltas(spark):
    one = snap(spark, "2026-07-12T16:17:00Z", release(2, "v2", [asset(21, "arm64", 4), asset(22, "x64", 10)]))
    two = snap(spark, "2026-07-13T16:17:00Z", release(2, "v2", [asset(21, "arm64", 6), asset(23, "x64", 1), asset(24, "sums.txt", 3)]), previous=one)
    got = assets_of(two)
    assert [(got[k].trackingState, got[k].downloadDelta, got[k].previousAssetId) for k in (21, 23, 24)] == [("existing", 2, None), ("replaced", 1, 22), ("new", 3, None)]
    assert two.first().totals.downloadIncrease == 6
    assert two.first().previousDate == "2026-07-12"


def test_matching_rules_beyond_the_scenarios(spark):
    one = snap(spark, "2026-07-01T00:00:00Z", release(1, "v1", [asset(1, "fell", 10), asset(2, "moved", 5), asset(3, "x", 1), asset(4, "gone", 1), asset(5, "dup", 1), asset(6, "dup", 2)]))
    two = snap(
        spark, "2026-07-02T00:00:00Z",
        release(1, "v1", [asset(1, "fell", 7), asset(3, "gone", 4), asset(9, "dup", 8)]), release(2, "v2", [asset(2, "moved", 6)]), previous=one,
    )
    got = assets_of(two)
    assert (got[1].trackingState, got[1].downloadDelta) == ("existing", 0)  # a fallen counter
    assert (got[2].trackingState, got[2].downloadDelta) == ("existing", 1)  # same id under another tag
    assert (got[3].trackingState, got[3].previousAssetId) == ("existing", None)  # id before name
    assert got[9].previousAssetId == 6  # the last of equal keys
    assert len(got) == 4  # a vanished asset leaves no row
    three = snap(spark, "2026-07-03T00:00:00Z", release(1, "v1", [asset(4, "gone2", 9)]), previous=two)
    assert (assets_of(three)[4].trackingState, assets_of(three)[4].downloadDelta) == ("new", 9)  # back after a day away


def test_empty_input_and_missing_collections(spark):
    s = snap(spark, "2026-07-12T00:00:00Z").first()
    assert s.totals == Row(releaseCount=0, assetCount=0, currentDownloads=0, downloadIncrease=0) and s.releases == []
    s = snap(spark, "2026-07-12T00:00:00Z", release(1, "v1", None), release(2, "v2", [], draft=None)).first()
    assert s.totals.releaseCount == 2 and s.totals.assetCount == 0
    flat = flat_releases(raw(spark, release(1, "v1", [asset(1, "a", 3)])))
    states = match_states(flat_assets(flat), snapshot_assets(spark.createDataFrame([], schema.SNAPSHOT)))
    assert totals(flat, states).first().asDict() == {"releaseCount": 1, "assetCount": 1, "currentDownloads": 3, "downloadIncrease": 3}


def test_names_orders_and_coercions(spark):
    s = snap(spark, "2026-07-12T00:00:00Z", release(1, "b", name=None), release(2, "A", name=""), release(3, "a", [asset(9, "n", "2.9"), asset(10, "n", "-3")]), release(4, "a", name="x")).first()
    assert [r.tagName for r in s.releases] == ["a", "a", "A", "b"] and [r.id for r in s.releases[:2]] == [3, 4]
    assert [r.name for r in s.releases[2:]] == ["A", "b"]
    assert [(a.id, a.downloadCount) for a in s.releases[0].assets] == [(10, 0), (9, 2)]
    raws = ["12", " 12 ", "", "12d", "1e3", "Infinity", "NaN", "-3", "2.9", None, "1e300", "0x10"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(raws)], "k int, v string")
    assert [r[0] for r in df.orderBy("k").select(coerce.non_negative_integer(F.col("v"))).collect()] == [12, 12, 0, 0, 1000, 0, 0, 0, 2, 0, (1 << 63) - 1, 16]
    names = spark.createDataFrame([(n,) for n in "b A a B v10 v2 _x -y".split()], "n string")
    assert [r.n for r in names.orderBy(coerce.collated(F.col("n"))).collect()] == "_x -y a A b B v10 v2".split()


def test_cells(spark):
    values = ['q"x', "A, B", "a\rb", "a\nb", None, " p ", "a|b", "a\r\nb"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(coerce.csv_cell(F.col("v"))).collect()] == ['"q""x"', '"A, B"', '"a\rb"', '"a\nb"', "", " p ", "a|b", '"a\r\nb"']
    assert [r[0] for r in df.select(coerce.markdown_cell(F.col("v"))).collect()] == ['q"x', "A, B", "a\rb", "a b", "", " p ", "a\\|b", "a b"]


def test_as_of_takes_the_newest_earlier_day(spark):
    days = spark.createDataFrame([Row(date=d, capturedAt=f"{d}T00:00:00.000Z", repository="o/r") for d in ("2026-07-01", "2026-07-05")])
    assert as_of(days, "2026-07-09").first().date == "2026-07-05"
    assert as_of(days, "2026-07-05").first().date == "2026-07-01"
    assert as_of(days, "2026-07-01").first() is None
    assert as_of(days, "2026-07-09", "other/r").first() is None


def test_history_is_rebuilt_from_stored_deltas(spark):
    one = snap(spark, "2026-07-12T00:00:00Z", release(2, "v2", [asset(21, "app", 4)], name="A, B"))
    two = snap(spark, "2026-07-13T00:00:00Z", release(2, "v2", [asset(21, "app", 6)], name="A, B"), release(3, "empty"), previous=one)
    lines = history_csv(two.unionByName(one)).split("\n")
    assert len(lines) == 4 and lines[-1] == "" and lines[0] == ",".join(schema.HISTORY.names)
    assert '"A, B"' in lines[1] and lines[1].startswith("2026-07-12") and lines[2].endswith("6,2,existing")
    tie = one.withColumn("ordinal", F.lit(0)).unionByName(one.withColumn("repository", F.lit("later")).withColumn("ordinal", F.lit(1)))
    assert [r.repository for r in latest_per_date(tie).collect()] == ["o/r"]
    assert history(spark.createDataFrame([], schema.SNAPSHOT)).count() == 0


def test_history_folder_has_the_same_rows(spark, tmp_path):
    one = snap(spark, "2026-07-12T00:00:00Z", release(2, 'v"2', [asset(21, " app ", 4)], name="A, B"))
    write_history(one, str(tmp_path / "h"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*")))
    assert text == history_csv(one)


def test_pages_are_followed_and_the_token_stays_in_the_header(spark):
    seen = []

    def fetch(url, headers):
        seen.append((url, headers))
        page = [{"id": len(seen), "tag_name": f"v{len(seen)}", "assets": [{"id": 1, "name": "a", "size": 5, "download_count": 3}]}]
        return 200, '<https://api/next?page=2>; rel="next"' if len(seen) == 1 else "", json.dumps(page)

    df = releases_api.read_api(spark, "o/r", "secret", fetch)
    assert [r.tag_name for r in df.orderBy("ordinal").collect()] == ["v1", "v2"]
    assert df.first().assets[0].download_count == "3"
    assert len(seen) == 2 and all(h["Authorization"] == "Bearer secret" and "secret" not in u for u, h in seen)
    assert "Authorization" not in releases_api.headers()


@pytest.mark.parametrize("answer", [(500, "", "boom"), (200, "", '{"message": "x"}')])
def test_bad_answers_raise(answer):
    with pytest.raises(RuntimeError):
        list(releases_api.fetch_pages("o/r", fetch=lambda u, h: answer))


def test_repository_and_link_rules():
    for bad in ("a", "a/b/c", "", None, "/b"):
        with pytest.raises(ValueError):
            releases_api.check_repository(bad)
    assert releases_api.check_repository("a/b/") == ("a", "b")
    assert releases_api.next_url('<p>; rel="prev", <n>;  REL="next"') == "n" and releases_api.next_url(None) == ""


def test_data_source_reads_a_local_server(spark):
    import http.server
    import threading

    class Api(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = 2 if "page=2" in self.path else 1
            self.send_response(200)
            if page == 1:
                self.send_header("link", f'<http://127.0.0.1:{self.server.server_port}/x?page=2>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps([{"id": page, "tag_name": f"v{page}", "assets": None}]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(releases_api.ReleasesSource)
    df = spark.read.format("releases").option("repository", "o/r").option("token", "hidden").option("root", f"http://127.0.0.1:{server.server_port}").load()
    assert [(r.ordinal, r.tag_name) for r in df.collect()] == [(0, "v1"), (1, "v2")]
    assert "hidden" not in df._jdf.queryExecution().toString()
    server.shutdown()


def test_daily_lifecycle(spark, tmp_path):
    out = str(tmp_path / "m")

    def day(moment, n):
        return job.write_metrics(spark, out, "o/r", moment, raw(spark, release(2, "v2", [asset(21, "app", n)]))).first()

    day("2026-07-12T16:17:00Z", 4)
    day("2026-07-12T18:00:00Z", 5)
    day("2026-07-13T16:17:00Z", 6)
    first = json.loads((tmp_path / "m/snapshots/2026-07-12.json").read_text())
    assert first["capturedAt"] == "2026-07-12T18:00:00.000Z" and first["releases"][0]["assets"][0]["downloadCount"] == 5
    assert first["previousDate"] is None and first["releases"][0]["assets"][0]["previousAssetId"] is None
    second = json.loads((tmp_path / "m/snapshots/2026-07-13.json").read_text())
    assert second["releases"][0]["assets"][0]["downloadDelta"] == 1
    assert json.loads((tmp_path / "m/latest.json").read_text())["date"] == "2026-07-13"
    assert len((tmp_path / "m/release-downloads.csv").read_text().splitlines()) == 3
    # A backfilled day compares with the day before it, moves latest.json and leaves later days alone.
    kept = (tmp_path / "m/snapshots/2026-07-13.json").read_text()
    back = day("2026-07-11T00:30:00+08:00", 2)
    assert back.date == "2026-07-10" and back.previousDate is None
    assert (tmp_path / "m/snapshots/2026-07-13.json").read_text() == kept
    assert json.loads((tmp_path / "m/latest.json").read_text())["date"] == "2026-07-10"


def test_state_folder_rules(spark, tmp_path):
    assert read_snapshots(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "2026-7-1.json").write_text("{}")
    (tmp_path / "latest.json").write_text("{}")
    (tmp_path / "2026-07-09.json").mkdir()
    assert read_snapshots(spark, str(tmp_path)).count() == 0
    (tmp_path / "2026-07-01.json").write_text(pretty(snap(spark, "2026-07-01T00:00:00Z", release(1, "v1", [asset(1, "a", 1)]))))
    assert read_snapshots(spark, str(tmp_path)).first().releases[0].assets[0].downloadCount == 1
    (tmp_path / "2026-07-02.json").write_text("{broken")
    with pytest.raises(Exception):
        read_snapshots(spark, str(tmp_path)).collect()


def test_report(spark):
    s = snap(spark, "2026-07-12T16:17:00Z", release(2, "macos|x", [asset(21, "app.zip", 6)], prerelease=True))
    text = report(s)
    assert "| Downloads so far | 6 |" in text and "| New since the last snapshot | 6 |" in text
    assert "| macos\\|x | app.zip | 6 | +6 | new |" in text and "one person can cause several" in text


def test_settings_and_times(spark, tmp_path, capsys):
    for env in ({}, {"GITHUB_REPOSITORY": "o/r"}, {"GITHUB_REPOSITORY": "", "GITHUB_TOKEN": "t"}):
        with pytest.raises(ValueError):
            job.settings(env)
    s = job.settings({"GITHUB_REPOSITORY": "o/r", "GITHUB_TOKEN": "t", "METRICS_OUTPUT_DIR": "", "METRICS_CAPTURED_AT": ""})
    assert s["output_dir"] == "metrics-data" and s["captured_at"]
    for bad in (None, "", "yesterday"):
        with pytest.raises(ValueError):
            job.normalised_time(bad)
    assert job.normalised_time("2026-07-12T00:30:00+08:00") == "2026-07-11T16:30:00.000Z"
    line = job.run(
        {"GITHUB_REPOSITORY": "o/r", "GITHUB_TOKEN": "t", "METRICS_OUTPUT_DIR": str(tmp_path), "METRICS_CAPTURED_AT": "2026-07-12T00:00:00Z"},
        lambda u, h: (200, "", json.dumps([{"id": 1, "tag_name": "v1", "assets": [{"id": 2, "name": "a", "download_count": 7}]}])),
    )
    assert json.loads(line)["totals"]["currentDownloads"] == 7 and json.loads(line)["date"] == "2026-07-12"


def test_stream_takes_captures_in_order(spark, tmp_path):
    from quillspark.streaming.daily import stream_captures

    inbox = tmp_path / "in"
    inbox.mkdir()
    for day, n in (("2026-07-13", 6), ("2026-07-12", 4)):
        body = {"capturedAt": f"{day}T00:00:00Z", "releases": [{"id": 1, "tag_name": "v1", "assets": [{"id": 2, "name": "a", "download_count": n}]}]}
        (inbox / f"{day}.json").write_text(json.dumps(body))
    for _ in range(2):  # the second run finds nothing new
        query = stream_captures(spark, str(inbox), str(tmp_path / "out"), "o/r", str(tmp_path / "cp"))
        query.awaitTermination()
    assert json.loads((tmp_path / "out/snapshots/2026-07-13.json").read_text())["previousDate"] == "2026-07-12"
    rows = (tmp_path / "out/release-downloads.csv").read_text().splitlines()
    assert len(rows) == 3 and rows[-1].endswith("6,2,existing")
