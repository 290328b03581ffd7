"""Fields of photo headers: a walk over TIFF directories, alone or inside a JPEG's Exif segment.

Both byte orders, values in place and by offset, rationals and sub-directories are read.
A directory that is met twice, more than ``MOST_DIRECTORIES`` of them, or one outside the data ends the
walk with an error; an entry whose values lie outside is left out. Only the first
``HEAD_BYTES`` of a file go to Python, so a field that lies behind them is missing.

Null, empty and unknown content gives null fields and an error. Repeated files give
repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 18
MOST_DIRECTORIES = 32

# Sizes of value types, and tag numbers.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
MAKE, MODEL, ORIENTATION, TIME, COMPRESSION, STRIPS, STRIP_BYTES, SUB, PREVIEW, PREVIEW_BYTES = 0x10F, 0x110, 0x112, 0x132, 0x103, 0x111, 0x117, 0x14A, 0x201, 0x202
EXIF, EXPOSURE, APERTURE, ISO, TAKEN, FOCAL, LENS = 0x8769, 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA434
POINTERS = (EXIF, SUB)

Directory = dict[int, tuple]


class Damaged(ValueError):
    """A header that cannot be walked."""


def walk(data: bytes) -> list[Directory]:
    """The directories of a TIFF header: tag numbers with their values, text as one ``str``, rationals as fractions or none."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise Damaged("no TIFF header")
    waiting, seen, out = [struct.unpack_from(f"{order}I", data, 4)[0]], set(), []
    while waiting:
        at = waiting.pop(0)
        if at == 0:
            continue
        if at in seen or len(seen) == MOST_DIRECTORIES:
            raise Damaged("directories form a loop" if at in seen else "too many directories")
        seen.add(at)
        if at + 2 > len(data):
            raise Damaged("directory outside the data")
        count = struct.unpack_from(f"{order}H", data, at)[0]
        if at + 2 + 12 * count > len(data):
            raise Damaged("directory outside the data")
        found: Directory = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            size = SIZES.get(kind, 0) * n
            start = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            if size and start + size <= len(data) and tag not in found:
                found[tag] = _values(data[start : start + size], kind, n, order)
        out.append(found)
        waiting += [p for t in POINTERS for p in found.get(t, ()) if isinstance(p, int)]
        if at + 6 + 12 * count <= len(data):
            waiting.append(struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0])
    return out


def _values(raw: bytes, kind: int, n: int, order: str) -> tuple:
    if kind == 2:
        return (raw.split(b"\0")[0].decode(errors="replace").strip(),)
    if kind == 7:
        return (raw,)
    if kind in (5, 10):
        parts = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
        return tuple(Fraction(a, b) if b else None for a, b in zip(parts[::2], parts[1::2]))
    return struct.unpack(f"{order}{n}{FORMS[kind]}", raw)


def segments(jpeg: bytes) -> Iterator[tuple[int, int, int]]:
    """``(marker, first byte of the payload, end)`` of a JPEG's segments up to its image data, which is the last, to the end."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        if jpeg[at + 1] == 0xFF:  # fill
            at += 1
            continue
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if size < 2:
            break
        if marker == 0xDA:
            yield marker, at + 4, len(jpeg)
            return
        yield marker, at + 4, min(at + 2 + size, len(jpeg))
        at += 2 + size
    raise Damaged("segments end without image data")


def header_of(content: bytes) -> bytes:
    """The TIFF header of a file: the file itself, or the Exif segment of a JPEG."""
    if content[:2] != b"\xff\xd8":
        return content
    try:
        for marker, start, end in segments(content):
            if marker == 0xE1 and content[start : start + 6] == b"Exif\0\0":
                return content[start + 6 : end]
    except Damaged:
        pass
    raise Damaged("no Exif segment")


def pack(main: dict[int, tuple[int, object]], exif: dict[int, tuple[int, object]] | None = None, order: str = "<") -> bytes:
    """A TIFF header from ``tag: (type, values)``: the main directory and, if given, the Exif directory."""
    head = 8
    parts = [main | ({EXIF: (4, [0])} if exif else {})] + ([exif] if exif else [])
    starts, at = [], head
    for entries in parts:
        starts.append(at)
        at += 6 + 12 * len(entries)
    out, extra = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, head)), bytearray()
    for entries in parts:
        out += struct.pack(f"{order}H", len(entries))
        for tag, (kind, values) in sorted(entries.items()):
            if tag == EXIF:
                values = [starts[1]]
            raw, n = _raw(kind, values, order)
            if len(raw) > 4:
                place = struct.pack(f"{order}I", at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
                raw = place
            out += struct.pack(f"{order}HHI", tag, kind, n) + raw.ljust(4, b"\0")
        out += b"\0" * 4
    return bytes(out + extra)


def _raw(kind: int, values, order: str) -> tuple[bytes, int]:
    if kind == 2:
        raw = values.encode() + b"\0"
        return raw, len(raw)
    if kind == 7:
        return values, len(values)
    if kind in (5, 10):
        return b"".join(struct.pack(f"{order}2{'I' if kind == 5 else 'i'}", *Fraction(v).as_integer_ratio()) for v in values), len(values)
    return struct.pack(f"{order}{len(values)}{FORMS[kind]}", *values), len(values)


def exif_segment(header: bytes) -> bytes:
    return b"\xff\xe1" + struct.pack(">H", len(header) + 8) + b"Exif\0\0" + header


def _number(value) -> float | None:
    return None if value is None else float(value)


#: Column, type, tag, and how its first value is shown.
FIELDS = [
    ("make", pa.string(), MAKE, str), ("model", pa.string(), MODEL, str), ("lens", pa.string(), LENS, str), ("taken", pa.string(), TAKEN, str), ("exposure_seconds", pa.float64(), EXPOSURE, _number),
    ("f_number", pa.float64(), APERTURE, _number), ("iso", pa.int32(), ISO, int), ("focal_mm", pa.float64(), FOCAL, _number), ("orientation", pa.int32(), ORIENTATION, int),
]


def fields_of(content: bytes | None) -> dict[str, object]:
    """The columns of ``FIELDS`` and ``error``; the first directory that has a tag counts, and the file's time where none says when it was taken."""
    try:
        directories = walk(header_of(content or b""))
    except Damaged as e:
        return {"error": str(e)}
    out: dict[str, object] = {}
    for name, _, tag, shown in FIELDS:
        values = next((d[tag] for d in directories if d.get(tag)), None) or (next((d[TIME] for d in directories if d.get(TIME)), None) if tag == TAKEN else None)
        try:
            out[name] = None if values is None else shown(values[0])
        except (TypeError, ValueError):
            out[name] = None
    if out["orientation"] not in range(1, 9):
        out["orientation"] = None
    return out


def read_exif(files: DataFrame, path_col: str = "path", content_col: str = "content", head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``(path, make, ..., orientation, error)`` per file; ``taken`` is a timestamp without a zone, read as UTC."""
    kind = files.schema[path_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fields_of(v.as_py()) for v in batch.column(1)]
            columns = [pa.array([f.get(n) for f in found], t) for n, t in [*[(n, t) for n, t, *_ in FIELDS], ("error", pa.string())]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[path_col, *[n for n, *_ in FIELDS], "error"])

    types = {pa.string(): "string", pa.float64(): "double", pa.int32(): "int"}
    fields = ", ".join(f"{n} {types[t]}" for n, t, *_ in FIELDS)
    rows = files.select(path_col, F.substring(F.col(content_col), 1, head_bytes).alias("head")).mapInArrow(run, f"`{path_col}` {kind}, {fields}, error string")
    return rows.withColumn("taken", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")))
