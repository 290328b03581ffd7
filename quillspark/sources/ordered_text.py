"""A sink for ordered text, and for files of bytes: rows that are dealt by ranges become one file, or one file per name, without passing the driver's memory.

Each task writes its rows' lines to part files of its own; the commit joins the parts of a
file in the order of their partitions, a block at a time, and moves the whole into place.
Only parts named by a committed task are joined, so a failed or repeated task leaves no
trace in the file; an abort removes what was written, and the former file stays.
"""

from __future__ import annotations

import contextlib
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspark.operators.durable import durable, release

BLOCK = 1 << 22
FOLDER_FILES = 1_000
READ_FILES = 100


@dataclass
class Parts(WriterCommitMessage):
    """What one task wrote: its partition, and a part's path for each file, in the order in which files came."""

    partition: int
    parts: dict[str, list[str]] = field(default_factory=dict)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _absolute(spark: SparkSession, path: str) -> str:
    """The path as the driver's file system understands it, so that tasks in other folders write to the same place."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()
    return whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


class OrderedText(DataSource):
    """``df.write.format("ordered_text").option("folder", ...)`` for columns ``file`` and ``line``, or ``file`` and ``content``.

    Option ``header`` is a first line of every file; files without rows are not written, but
    for the file that option ``file`` names. Lines end with a line feed; contents, which
    are bytes, follow each other as they are.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names not in (["file", "line"], ["file", "content"]):
            raise ValueError("ordered_text takes the columns file and line, or file and content")
        writer = _Writer(dict(self.options), schema.names[1] == "line")
        files, root = _at(writer.scratch)
        files.create_dir(root, recursive=True)
        return writer


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], text: bool = True):
        self.text = text
        self.folder, self.header, self.always = options["folder"].rstrip("/"), options.get("header"), options.get("file")
        self.scratch = f"{self.folder}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        files, root = _at(self.scratch)
        if files.get_file_info(root).type == fs.FileType.NotFound:  # the job was aborted: a task that makes the folder again would leave it
            raise FileNotFoundError(root)
        said, own, out, current = Parts(task.partitionId()), f"{root}/{task.partitionId()}-{task.taskAttemptId()}", None, None
        try:
            for name, line in iterator:
                if name != current:
                    if out is not None:
                        out.close()
                    current, path = name, f"{own}-{sum(map(len, said.parts.values()))}"
                    said.parts.setdefault(name, []).append(path)
                    out = files.open_output_stream(path, buffer_size=BLOCK)
                out.write((line or "").encode() + b"\n" if self.text else line or b"")
        finally:
            if out is not None:
                out.close()
        return said

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _at(self.folder)
        scratch = _at(self.scratch)[1]
        files.create_dir(root, recursive=True)
        names: dict[str, list[str]] = {self.always: []} if self.always else {}
        for said in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for name, parts in said.parts.items():
                names.setdefault(name, []).extend(parts)
        files.create_dir(scratch, recursive=True)
        for k, (name, parts) in enumerate(names.items()):
            files.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            if len(parts) == 1 and self.header is None:
                files.move(parts[0], f"{root}/{name}")
                continue
            whole = f"{scratch}/whole-{k}"
            with files.open_output_stream(whole, buffer_size=BLOCK) as out:
                if self.header is not None:
                    out.write(self.header.encode() + b"\n")
                for part in parts:
                    with files.open_input_stream(part) as read:
                        shutil.copyfileobj(read, out, BLOCK)
            files.move(whole, f"{root}/{name}")
        files.delete_dir(scratch)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _drop(self.scratch)


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row's bytes (``file``, ``content``) as a file of its own; of rows with one name any one stays.

    Tasks write all files beside their places first, and then move them, so a failure
    while rows are made leaves the former files. Nothing about a file passes the driver. A task that is
    repeated moves what its forerunner left; the list of parts names those of committed tasks only.
    """
    spark = rows.sparkSession
    target = _absolute(spark, folder).rstrip("/")
    staged = f"{target}/_parts-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(staged)
        own = f"{root}/{uuid.uuid4().hex}"
        n = 0
        for batch in batches:
            parts = []
            for content in batch.column(1):
                if n % FOLDER_FILES == 0:
                    files.create_dir(f"{own}-{n // FOLDER_FILES}", recursive=False)  # fails once the job's folder is gone
                parts.append(f"{own}-{n // FOLDER_FILES}/{n}")
                with files.open_output_stream(parts[-1]) as out:
                    out.write(content.as_py() or b"")
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string())], names=["file", "part"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(target)
        made = set()
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{root}/{name}"
                if (parent := place.rpartition("/")[0]) not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                try:
                    files.move(part, place)
                except OSError:
                    if files.get_file_info(part).type != fs.FileType.NotFound or files.get_file_info(place).type == fs.FileType.NotFound:
                        raise  # else an earlier attempt has moved it
            yield batch.slice(0, 0)

    files, root = _at(staged)
    files.create_dir(root, recursive=True)
    try:
        parts = durable(rows.select("file", "content").mapInArrow(put, "file string, part string"))
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts.repartition(tasks, "file").mapInArrow(move, "file string, part string").write.format("noop").mode("overwrite").save()
        release(parts)
    finally:
        _drop(staged)


def _drop(scratch: str) -> None:
    """Delete a folder into which tasks that are being stopped may still write for a moment."""
    for wait in (0, 0.1, 0.3, 1, 3):
        time.sleep(wait)
        files, root = _at(scratch)
        with contextlib.suppress(OSError):
            if files.get_file_info(root).type != fs.FileType.NotFound:
                files.delete_dir(root)
            return


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """``(file, content)`` of files below ``folder`` by the column ``file`` of ``names``, read by tasks; a missing one has a null content."""
    target = _absolute(names.sparkSession, folder).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(target)
        for batch in batches:
            for k in range(0, batch.num_rows, READ_FILES):
                part = batch.slice(k, READ_FILES)
                contents = []
                for name in part.column(0).to_pylist():
                    try:
                        with files.open_input_stream(f"{root}/{name}") as read:
                            contents.append(read.read())
                    except FileNotFoundError:
                        contents.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents, pa.binary())], names=["file", "content"])

    return names.select(F.col("file").cast("string").alias("file")).mapInArrow(run, "file string, content binary")


def write_ordered(lines: DataFrame, folder: str, file: str | None = None, header: str | None = None) -> None:
    """Write rows in the order of the table's partitions: ``line`` to one file, or ``file`` and ``line`` (or the bytes ``content``) to a file per name."""
    lines.sparkSession.dataSource.register(OrderedText)
    value = "content" if "content" in lines.columns else "line"
    rows = lines.select(F.lit(file).alias("file"), value) if file else lines.select("file", value)
    writer = rows.write.format("ordered_text").mode("append").option("folder", _absolute(lines.sparkSession, folder))
    for key, value in (("header", header), ("file", file)):
        writer = writer if value is None else writer.option(key, value)
    writer.save()
