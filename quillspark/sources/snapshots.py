"""The snapshot state: one JSON document per day, and its derived files."""

from __future__ import annotations

import codecs
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark import schema
from quillspark.functions.coerce import csv_cell
from quillspark.operators.durable import durable
from quillspark.operators.history import history, ordered, report_rows, state_history
from quillspark.sources.ordered_text import _at as at
from quillspark.sources.ordered_text import write_ordered

NAMES = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].json"


class Folder:
    """A folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))

    def exists(self) -> bool:
        return self._fs.exists(self._at(""))

    def files(self, pattern: str) -> list[str]:
        """Regular files directly inside whose names match."""
        return sorted(s.getPath().toString() for s in self._fs.globStatus(self._at(pattern)) or [] if s.isFile() and not s.isSymlink())

    def partitions(self, key: str) -> list[str]:
        """Values of the partitions ``key=value`` directly inside."""
        found = self._fs.globStatus(self._at(f"{key}=*")) if self.exists() else []
        return sorted(s.getPath().getName().partition("=")[2] for s in found or [] if s.isDirectory())

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All day documents directly in a folder; other names and subfolders are skipped.

    A missing folder is an empty table; a malformed document fails the read.
    """
    folder = Folder(spark, path)
    files = folder.files(NAMES) if folder.exists() else []
    if not files:
        return spark.createDataFrame([], schema.SNAPSHOT)
    return spark.read.schema(schema.SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(files)


def read_releases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved API pages (JSON arrays of releases, one a file or, with ``lines``, one a line), with the order of files and rows as ``ordinal``."""
    raw = spark.read.schema(schema.RAW_RELEASES).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return raw.withColumn("ordinal", F.monotonically_increasing_id())


def pretty(snapshot: DataFrame) -> str:
    """The document as JSON with two spaces of indent, nulls kept, and a final newline."""
    row = snapshot.select(F.to_json(F.struct(*schema.SNAPSHOT.names), {"ignoreNullFields": "false"}).alias("j")).first()
    return json.dumps(json.loads(row.j), indent=2, ensure_ascii=False) + "\n"


def history_lines(rows: DataFrame) -> DataFrame:
    """CSV lines (column ``line``) of ordered history rows: quotes only where needed."""
    return rows.select(F.array_join(F.array(*[csv_cell(F.col(c)) for c in schema.HISTORY.names]), ",").alias("line"))


def history_csv(snapshots: DataFrame) -> str:
    """A small history as CSV text; :func:`write_history_file` writes one of any size."""
    lines = [r[0] for r in history_lines(history(snapshots)).toLocalIterator()]
    return "\n".join([",".join(schema.HISTORY.names), *lines]) + "\n"


def write_history_file(rows: DataFrame, folder: str, name: str) -> None:
    """The whole history of flat state rows as one ordered CSV file with line feeds; it never passes the driver's memory."""
    write_ordered(history_lines(ordered(state_history(rows))), folder, name, ",".join(schema.HISTORY.names))


FIRST, LAST = -(1 << 63), (1 << 63) - 1


def _pieces(rows: DataFrame) -> DataFrame:
    """``(date, repository, r, a, kind, comma, filled, json)``: documents in pieces, a row for each asset, start and end; r and a order them."""
    key = ["repository", "date"]
    sums = ["downloadCount", "downloadDelta"]
    total = lambda c: F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(None)).otherwise(F.sum(c)).alias(c)
    each = rows.where("kind = 'asset'")
    per_release = durable(each.groupBy(*key, "release_nth").agg(F.min("asset_nth").alias("first"), F.count("*").alias("n"), *[total(c) for c in sums]))
    zero = F.lit(0).cast("bigint")
    releases = rows.where("kind = 'release'").drop(*sums).join(per_release, [*key, "release_nth"], "left")
    releases = durable(releases.withColumns({c: F.when(F.col("n").isNull(), zero).otherwise(F.col(c)) for c in sums}).withColumn("n", F.coalesce("n", zero)))
    per_day = releases.groupBy(*key).agg(F.min("release_nth").alias("first"), F.count("*").alias("n_releases"), F.sum("n").alias("n"), *[total(c) for c in sums])
    heads = durable(rows.where("kind = 'snapshot'").select(*key, "capturedAt", "previousDate").join(per_day, key, "left"))
    none = F.lit(None)
    empty = lambda known: F.array().cast(known.dataType)
    totals = F.struct(F.coalesce("n_releases", zero).alias("releaseCount"), F.coalesce("n", zero).alias("assetCount"), *[F.when(F.col("n").isNull(), zero).otherwise(F.col(c)).alias(n) for c, n in zip(sums, ("currentDownloads", "downloadIncrease"))])
    document = F.struct(F.lit(schema.SCHEMA_VERSION).alias("schemaVersion"), "repository", "capturedAt", "date", "previousDate", totals.alias("totals"), empty(schema.SNAPSHOT["releases"]).alias("releases"))
    release = F.struct(F.col("releaseId").alias("id"), "tagName", F.col("releaseName").alias("name"), "prerelease", "publishedAt", "releaseUrl", empty(schema.RELEASE["assets"]).alias("assets"))
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})

    def piece(df: DataFrame, kind: str, r: Column, a: Column, comma: Column, filled: Column, text: Column) -> DataFrame:
        return df.select("date", "repository", r.cast("long").alias("r"), a.cast("long").alias("a"), F.lit(kind).alias("kind"), comma.cast("boolean").alias("comma"), filled.cast("boolean").alias("filled"), text.cast("string").alias("json"))

    first, last, r, filled = F.lit(FIRST), F.lit(LAST), F.col("release_nth"), F.col("n") > 0
    listed = releases.join(heads.select(*key, F.col("first").alias("first_r")), key)
    held = each.join(listed.select(*key, "release_nth", "first"), [*key, "release_nth"])
    return (
        piece(heads, "document", first, first, none, none, as_json(document))
        .unionByName(piece(heads, "document end", last, last, none, F.coalesce("n_releases", zero) > 0, none))
        .unionByName(piece(listed, "release", r, first, r != F.col("first_r"), none, as_json(release)))
        .unionByName(piece(listed, "release end", r, last, none, filled, none))
        .unionByName(piece(held, "asset", r, F.col("asset_nth"), F.col("asset_nth") != F.col("first"), none, as_json(F.struct(*schema.ASSET.names))))
    )


def _text(kind: str, comma: bool | None, filled: bool | None, piece: str | None) -> str:
    if kind == "document end":
        return ("\n  ]" if filled else "]") + "\n}\n"
    if kind == "release end":
        return ("\n      ]" if filled else "]") + "\n    }"
    depth = {"document": 0, "release": 4, "asset": 8}[kind]
    text = json.dumps(json.loads(piece), indent=2, ensure_ascii=False).replace("\n", "\n" + " " * depth)
    lead = "" if kind == "document" else (",\n" if comma else "\n") + " " * depth
    return lead + (text if kind == "asset" else text[: text.rindex("]")])


def write_documents(rows: DataFrame, folder: str) -> None:
    """Each day of flat state rows as a document ``<date>.json``, as :func:`pretty` writes it.

    A document is written in pieces, dealt by ranges, so no task and no row holds all of one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, *piece in zip(*[c.to_pylist() for c in batch.columns]):
                if not names or names[-1] != name:
                    names.append(name)
                    texts.append([])
                texts[-1].append(_text(*piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(["".join(t).encode() for t in texts], pa.binary())], names=["file", "content"])

    dealt = durable(_pieces(rows)).orderBy("date", "repository", "r", "a")
    named = dealt.where("date is not null").select(F.concat("date", F.lit(".json")).alias("file"), "kind", "comma", "filled", "json")
    write_ordered(named.mapInArrow(run, "file string, content binary"), folder)


class _Reader:
    """JSON text from a stream, a value at a time; no more than a block and one value are held."""

    def __init__(self, stream, block: int = 1 << 20):
        self.read, self.block = codecs.getreader("utf-8")(stream).read, block
        self.held, self.at, self.ended, self.decode = "", 0, False, json.JSONDecoder().raw_decode

    def more(self) -> None:
        new = self.read(self.block)
        self.held, self.at, self.ended = self.held[self.at :] + new, 0, not new

    def peek(self) -> str:
        while True:
            while self.at < len(self.held) and self.held[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.held) or self.ended:
                return self.held[self.at : self.at + 1]
            self.more()

    def take(self, sign: str) -> bool:
        found = self.peek() == sign
        self.at += found
        return found

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"malformed document: {sign} expected")

    def value(self):
        self.peek()
        while True:
            try:
                out, end = self.decode(self.held, self.at)
                if end < len(self.held) or self.ended:
                    self.at = end
                    return out
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()

    def fields(self) -> Iterator[str]:
        """The keys of an object; who iterates takes each value."""
        self.need("{")
        if self.take("}"):
            return
        while True:
            key = self.value()
            self.need(":")
            yield key
            if self.take("}"):
                return
            self.need(",")

    def items(self) -> Iterator[int]:
        """The places in a list; who iterates takes each value. A null is an empty list."""
        if self.peek() == "n":
            self.value()
            return
        self.need("[")
        if self.take("]"):
            return
        for n in itertools.count():
            yield n
            if self.take("]"):
                return
            self.need(",")


def _walk(reader: _Reader) -> Iterator[tuple[str, int, object]]:
    """A document's parts as they come: its own fields, each release's own fields, each asset with its release's place."""
    head = {}
    for key in reader.fields():
        if key != "releases":
            head[key] = reader.value()
            continue
        for r in reader.items():
            own = {}
            if reader.peek() != "{":
                reader.value()
            else:
                for field in reader.fields():
                    if field != "assets":
                        own[field] = reader.value()
                        continue
                    for _ in reader.items():
                        yield "asset", r, reader.value()
            yield "release", r, own
    yield "snapshot", 0, head
    if reader.peek():
        raise ValueError("malformed document: text behind its end")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``rows_of(read_snapshots(spark, path))``, a file a task: documents are walked through twice, for what orders and heads say and for assets, and never held."""
    folder = Folder(spark, path)
    files = folder.files(NAMES) if folder.exists() else []
    if not files:
        return spark.createDataFrame([], schema.STATE)
    shape = to_arrow_schema(schema.STATE)
    labels = {"releaseId": "id", "tagName": "tagName", "releaseName": "name", "prerelease": "prerelease", "publishedAt": "publishedAt", "releaseUrl": "releaseUrl"}

    def of(path: str) -> Iterator[dict]:
        store, place = at(path.removeprefix("file:") if path.startswith("file:/") else path)
        with store.open_input_stream(place) as stream:
            known = [(kind, r, x) for kind, r, x in _walk(_Reader(stream)) if kind != "asset"]
        document = next(x for kind, _, x in known if kind == "snapshot")
        head = {k: document.get(k) for k in ("repository", "capturedAt", "date", "previousDate")}
        releases = {r: head | {n: x.get(f) for n, f in labels.items()} | {"release_nth": r + 1} for kind, r, x in known if kind == "release"}
        yield head | {"kind": "snapshot"}
        yield from (x | {"kind": "release"} for x in releases.values())
        last, n = None, 0
        with store.open_input_stream(place) as stream:
            for kind, r, x in _walk(_Reader(stream)):
                if kind == "asset":
                    n = n + 1 if r == last else 1
                    last = r
                    yield {f: (x or {}).get(f) for f in schema.ASSET.names} | releases[r] | {"kind": "asset", "asset_nth": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = of(name)
                while held := list(itertools.islice(rows, 5_000)):
                    yield pa.RecordBatch.from_pylist(held, shape)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(run, schema.STATE)


def write_history(snapshots: DataFrame, path: str) -> None:
    """The history as a Spark CSV folder, for states that no single file should hold.

    ``history`` orders by range partitioning, so part files follow each other.
    """
    history(snapshots).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def report(snapshot: DataFrame) -> str:
    """Markdown: the totals, one line per asset, and how to read them."""
    repository, date, moment, downloads, increase = snapshot.select("repository", "date", "capturedAt", "totals.currentDownloads", "totals.downloadIncrease").first()
    lines = [r[0] for r in report_rows(snapshot).collect()]
    facts = {"Repository": repository, "Day (UTC)": date, "Captured": moment, "Downloads so far": downloads, "New since the last snapshot": increase}
    return "\n".join([
        f"# Downloads of {repository} on {date}", "", "Generated by the daily job; changes here are overwritten by the next run.", "",
        "| Fact | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in facts.items()], "",
        "| Tag | Asset | Downloads | New | State |", "| --- | --- | ---: | ---: | --- |", *lines, "",
        "A download is a request for an asset, so one person can cause several. A replaced asset",
        "starts again from zero and counts in full, as a new one does; drafts are left out.",
    ]) + "\n"
