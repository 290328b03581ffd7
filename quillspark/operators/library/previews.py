"""Embedded previews of raw files, and a cache of them keyed by photo and engine version.

A raw container is a TIFF whose directories point at JPEG streams. Every pointer is
followed and checked: it must lie inside the file, begin and end as a JPEG, and state its
size in pixels; the one with most pixels is the preview. The container's orientation
goes into the preview's own header, so that any viewer turns it, and into its display size.
A pointer that leads elsewhere is passed over; a file without a sound one gets an error.

Null or unknown content gives an error, not a preview. Repeated files give repeated rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.library import exif
from quillspark.operators.library.exports import cache_misses

VERSION = 1
FIELDS = "width int, height int, orientation int, preview binary, error string"


def frame_size(jpeg: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header."""
    try:
        for marker, start, end in exif.segments(jpeg):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and end - start >= 5:
                height, width = struct.unpack_from(">HH", jpeg, start + 1)
                return width, height
    except exif.Damaged:
        pass
    return None


def pointers(directories: list[exif.Directory]) -> Iterator[tuple[int, int]]:
    """Places and lengths of JPEG streams that the directories name."""
    for d in directories:
        yield from zip(d.get(exif.PREVIEW, ()), d.get(exif.PREVIEW_BYTES, ()))
        if d.get(exif.COMPRESSION, (0,))[0] in (6, 7) and len(d.get(exif.STRIPS, ())) == 1:
            yield from zip(d[exif.STRIPS], d.get(exif.STRIP_BYTES, ()))


def with_orientation(jpeg: bytes, orientation: int) -> bytes:
    """The stream with an Exif segment that says its orientation instead of any it had; image data stays as it is."""
    kept = [jpeg[start - 4 : end] for marker, start, end in exif.segments(jpeg) if not (marker == 0xE1 and jpeg[start : start + 6] == b"Exif\0\0")]
    return jpeg[:2] + exif.exif_segment(exif.pack({exif.ORIENTATION: (3, [orientation])})) + b"".join(kept)


def preview_of(content: bytes | None) -> tuple:
    """The columns of ``FIELDS`` for one container."""
    try:
        directories = exif.walk(content or b"")
    except exif.Damaged as e:
        return None, None, None, None, str(e)
    best = None
    for at, size in pointers(directories):
        stream = content[at : at + size] if at + size <= len(content) else b""
        if stream[:3] == b"\xff\xd8\xff" and stream[-2:] == b"\xff\xd9" and (frame := frame_size(stream)):
            if best is None or frame[0] * frame[1] > best[0] * best[1]:
                best = (*frame, stream)
    if best is None:
        return None, None, None, None, "no sound preview"
    turn = next((d[exif.ORIENTATION][0] for d in directories if exif.ORIENTATION in d), 1)
    turn = turn if turn in range(1, 9) else 1
    width, height, stream = best
    return *((height, width) if turn >= 5 else (width, height)), turn, with_orientation(stream, turn), None


def embedded_previews(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(path, width, height, orientation, preview, error)`` per raw file; sizes are those on display."""
    kind = files.schema[path_col].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [preview_of(v.as_py()) for v in batch.column(1)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[path_col, "width", "height", "orientation", "preview", "error"])

    return files.select(path_col, content_col).mapInArrow(run, f"`{path_col}` {kind}, {FIELDS}")


def fill_cache(files: DataFrame, cache: DataFrame, version: int = VERSION, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """New cache rows ``(path, engine_version, width, ..., error)``: previews of the files that the cache lacks in this version.

    Only those files' content is read by Python; failures are rows too, so they are not tried again.
    """
    wanted = files.withColumn("engine_version", F.lit(version))
    missing = cache_misses(wanted, cache, [path_col, "engine_version"])
    return embedded_previews(missing, path_col, content_col).withColumn("engine_version", F.lit(version))
