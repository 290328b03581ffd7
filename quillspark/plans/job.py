"""The daily job: read state, look up as of, build, upsert, rebuild the views."""

from __future__ import annotations

import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.counters import documents, previous_assets, rows_of, snapshot_rows
from quillspark.operators.durable import durable
from quillspark.sources.releases_api import read_api
from quillspark.sources.snapshots import NAMES, Folder, pretty, read_snapshots, report, write_history_file
from quillspark.sources.state import earlier_day, read_day, read_state, write_days


def normalised_time(captured_at: str | None) -> str:
    """ISO text in UTC with milliseconds; text without a zone is UTC. Null or unreadable text is refused."""
    try:
        moment = datetime.fromisoformat(captured_at or "")
    except ValueError:
        raise ValueError("a valid capture time is required") from None
    moment = moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)
    return moment.isoformat(timespec="milliseconds").replace("+00:00", "Z")


def write_metrics(spark: SparkSession, output_dir: str, repository: str, captured_at: str, releases: DataFrame, same_repository: bool = False) -> DataFrame:
    """Write the day's rows to the state table, then the views: documents, ``latest.json``, report and history; return the snapshot.

    The state is a table partitioned by date: the day before is found by partition and read
    alone, and the same day's run replaces its partition. A folder that has only
    documents is taken over first. A backfilled day leaves later days as they are and becomes ``latest.json``.
    """
    if not repository:
        raise ValueError("a repository is required")
    moment = normalised_time(captured_at)
    table, views, days = f"{output_dir}/state", Folder(spark, output_dir), Folder(spark, f"{output_dir}/snapshots")
    days.make()
    if not Folder(spark, table).exists() and days.files(NAMES):
        write_days(rows_of(read_snapshots(spark, days.path)), table)
    releases = durable(releases if "ordinal" in releases.columns else releases.withColumn("ordinal", F.monotonically_increasing_id()))
    before = earlier_day(spark, table, moment[:10], repository if same_repository else None)
    previous = previous_assets(read_day(spark, table, before))
    rows = durable(snapshot_rows(releases, previous, repository, moment, before))
    write_days(rows, table)
    snapshot = durable(documents(rows))
    document = pretty(snapshot)
    days.write(f"{moment[:10]}.json", document)
    views.write("latest.json", document)
    views.write("README.md", report(snapshot))
    write_history_file(read_state(spark, table), output_dir, "release-downloads.csv")
    return snapshot


def settings(env: dict[str, str]) -> dict[str, str]:
    """Repository, token, output folder and time from the environment; an empty value counts as unset."""
    if not env.get("GITHUB_REPOSITORY") or not env.get("GITHUB_TOKEN"):
        raise ValueError("GITHUB_REPOSITORY and GITHUB_TOKEN are required")
    return {
        "repository": env["GITHUB_REPOSITORY"], "token": env["GITHUB_TOKEN"],
        "output_dir": env.get("METRICS_OUTPUT_DIR") or "metrics-data",
        "captured_at": env.get("METRICS_CAPTURED_AT") or datetime.now(UTC).isoformat(timespec="milliseconds"),
    }


def run(env: dict[str, str], fetch=None) -> str:
    """One run from settings; returns the summary line."""
    s = settings(env)
    spark = SparkSession.builder.appName("release-metrics").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    releases = read_api(spark, s["repository"], s["token"], fetch)
    snapshot = write_metrics(spark, s["output_dir"], s["repository"], s["captured_at"], releases)
    row = snapshot.select("date", "totals").first()
    return json.dumps({"repository": s["repository"], "date": row.date, "outputDir": s["output_dir"], "totals": row.totals.asDict()})


def main() -> int:
    try:
        print(run(dict(os.environ)))
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
