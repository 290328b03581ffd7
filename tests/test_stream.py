"""The stream with keyed state against the batch job."""

import json

import pytest
from oracle import canonical
from pyspark.sql import functions as F

from quillspark.operators.counters import previous_assets, snapshot_rows
from quillspark.operators.durable import durable
from quillspark.plans.job import normalised_time
from quillspark.sources.state import earlier_day, read_day, read_state, write_days
from quillspark.streaming.daily import CAPTURE, SHARDS, capture_rows, dealt, stream_captures, stream_state


def capture(moment, *assets, repository=None, extra=()):
    """A release v1 with assets ``(id, name, count)``, an empty release, a draft, and more releases."""
    made = [{"id": i, "name": n, "size": 3, "download_count": c} for i, n, c in assets]
    releases = [{"id": 9, "tag_name": "v0", "name": "", "assets": None}, {"id": 1, "tag_name": "v1", "assets": made}, {"id": 8, "tag_name": "v8", "draft": True, "assets": made}, *extra]
    return {"capturedAt": moment, "releases": releases} | ({"repository": repository} if repository else {})


DAYS = [
    capture("2026-07-13T00:00:00Z", (2, "b", "6"), (3, "B", 1), (4, "a", None), (5, "a", 7), extra=[{"id": 2, "tag_name": "V1", "assets": [{"id": 6, "name": "x", "download_count": "0x10"}]}]),
    capture("2026-07-15T03:00:00+08:00", (2, "b", 9), (7, "a", 8), (6, "moved", 20)),
    capture("2026-07-17T00:00:00", (2, "b", 4), (8, "new", 1)),
    {"capturedAt": "2026-07-18T00:00:00Z", "releases": []},
    capture("2026-07-19T00:00:00Z", (2, "b", 5)),
]
LATE = [capture("2026-07-16T00:00:00Z", (2, "b", 10), (7, "a", 9)), capture("2026-07-12T00:00:00Z", (2, "b", 1)), capture("2026-07-19T05:00:00Z", (2, "b", 6), (8, "new", 2))]


def batch(spark, path, captures, repository="o/r"):
    """The batch job's rows, capture by capture."""
    for c in captures:
        moment = normalised_time(c["capturedAt"])
        releases = spark.createDataFrame([c], CAPTURE).select(F.posexplode("releases").alias("ordinal", "release")).select("ordinal", "release.*")
        before = earlier_day(spark, path, moment[:10])
        write_days(durable(snapshot_rows(durable(releases), previous_assets(read_day(spark, path, before)), repository, moment, before)), path)
    return read_state(spark, path)


def rows(df):
    return canonical(df.columns, df.collect())


def put(folder, name, *captures):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(c) + "\n" for c in captures))


def run(spark, tmp_path, checkpoint="cp", **options):
    query = stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "out"), "o/r", str(tmp_path / checkpoint), lines=True, **options)
    query.awaitTermination()


def test_stream_equals_the_batch_job_with_late_days_and_replays(spark, tmp_path):
    put(tmp_path / "in", "1.json", *DAYS[3:], *DAYS[:2])
    put(tmp_path / "in", "2.json", DAYS[2])
    run(spark, tmp_path, views=False)
    want = batch(spark, str(tmp_path / "batch"), DAYS)
    assert rows(stream_state(spark, str(tmp_path / "out"))) == rows(want)
    put(tmp_path / "in", "3.json", *LATE)
    run(spark, tmp_path, views=False)
    # Within a batch captures come in order of time.
    want = batch(spark, str(tmp_path / "batch"), [LATE[1], LATE[0], LATE[2]])
    assert rows(stream_state(spark, str(tmp_path / "out"))) == rows(want)
    run(spark, tmp_path, views=False)  # finds nothing new
    run(spark, tmp_path, "fresh", views=False)  # a new checkpoint takes all captures up again, each day once
    want = batch(spark, str(tmp_path / "again"), sorted(DAYS[:4] + LATE, key=lambda c: normalised_time(c["capturedAt"])))
    assert rows(stream_state(spark, str(tmp_path / "out"))) == rows(want)


def test_repositories_have_their_own_chains(spark, tmp_path):
    put(tmp_path / "in", "1.json", *DAYS[:2], *[c | {"repository": "x/y"} for c in DAYS[1:4]])
    run(spark, tmp_path)
    got = stream_state(spark, str(tmp_path / "out"))
    assert rows(got.where("repository = 'o/r'")) == rows(batch(spark, str(tmp_path / "a"), DAYS[:2]))
    assert rows(got.where("repository = 'x/y'")) == rows(batch(spark, str(tmp_path / "b"), DAYS[1:4], "x/y"))
    assert len((tmp_path / "out/release-downloads.csv").read_text().splitlines()) == 1 + got.where("kind = 'asset'").count()


def test_captures_beyond_the_retained_days_are_kept_as_late(spark, tmp_path):
    put(tmp_path / "in", "1.json", DAYS[0], DAYS[4])
    run(spark, tmp_path, views=False, retain_days=3)
    put(tmp_path / "in", "2.json", DAYS[1], DAYS[2])
    run(spark, tmp_path, views=False, retain_days=3)
    day, late = (stream_state(spark, str(tmp_path / "out"), s).where("kind = 'snapshot'").orderBy("date").collect() for s in ("day", "late"))
    assert [(r.date, r.previousDate) for r in day] == [("2026-07-13", None), ("2026-07-17", None), ("2026-07-19", "2026-07-13")]
    assert [r.date for r in late] == ["2026-07-14"]


def test_assets_of_one_repository_are_dealt_apart(spark, tmp_path):
    """No group holds more than a small share of a repository; ids that move and names that come again are found across parts."""
    first = capture("2026-07-13T00:00:00Z", *[(k, f"n{k}", k) for k in range(2000)])
    second = capture("2026-07-14T00:00:00Z", *[(k + 5000 * (k % 3 == 1), f"n{k}" if k % 3 else f"m{k}", 2 * k) for k in range(2000)], (9999, "x", 4))
    rows_ = dealt(capture_rows(spark.createDataFrame([first], "capturedAt string, releases " + CAPTURE["releases"].dataType.simpleString()).selectExpr("'o/r' repository", "*").withColumn("token", F.rand())))
    sizes = [r["count"] for r in rows_.groupBy("repository", "shard").count().collect()]
    assert len(sizes) == SHARDS and max(sizes) < 2 * 2 * 2000 / SHARDS and sum(sizes) == 2 * 2000 + SHARDS + 2
    put(tmp_path / "in", "1.json", first, second, second)
    run(spark, tmp_path, views=False)
    got = stream_state(spark, str(tmp_path / "out"))
    want = batch(spark, str(tmp_path / "batch"), [first, second])
    twice = want.where("date = '2026-07-14'")
    assert rows(got) == rows(want.unionByName(twice))


def test_capture_rows_fail_without_a_time_and_take_empty_ones(spark):
    assert capture_rows(spark.createDataFrame([("o/r", "2026-07-12T00:00:00Z", None)], CAPTURE)).select("kind", "date").collect() == [("snapshot", "2026-07-12")]
    with pytest.raises(Exception, match="valid capture time"):
        capture_rows(spark.createDataFrame([("o/r", "yesterday", None)], CAPTURE)).collect()
