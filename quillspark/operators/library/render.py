"""Rendered copies: pixels converted between colour profiles and stored without loss as PNG or TIFF.

Values are linearised, taken through one 3x3 matrix and encoded again, all in numpy over
whole images. Matrices come from the profiles' primaries and white; both profiles have the same
white, so no adaptation is needed between them. Adobe RGB copies carry an ICC profile
made here, sRGB copies none.

A photo is ``(photo, width, height, pixels)`` with three bytes a pixel. Null or short pixels and sizes
that are not positive give an error and no content. JPEG is left to an encoder of the caller's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.library.exports import PROFILES, render_manifest
from quillspark.sources.ordered_text import write_files

# Chromaticities of the primaries and of the white D65, the Adobe RGB exponent, and the white D50 of ICC profiles.
PRIMARIES = {"srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "adobe_rgb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06))}
WHITE = (0.3127, 0.3290)
GAMMA = 563 / 256
D50 = (0.9642, 1.0, 0.8249)
TOGETHER = 1 << 18
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


def _xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def to_xyz(profile: str) -> np.ndarray:
    """The matrix from linear values of a profile to XYZ: primaries scaled so that equal values are white."""
    columns = np.stack([_xyz(*p) for p in PRIMARIES[profile]], axis=1)
    return columns * np.linalg.solve(columns, _xyz(*WHITE))


def matrix(source: str, target: str) -> np.ndarray:
    return np.linalg.solve(to_xyz(target), to_xyz(source))


def linear(values: np.ndarray, profile: str) -> np.ndarray:
    """Values from 0 to 1 without their transfer curve."""
    if profile == "adobe_rgb":
        return values**GAMMA
    return np.where(values <= 0.04045, values / 12.92, ((values + 0.055) / 1.055) ** 2.4)


def encoded(values: np.ndarray, profile: str) -> np.ndarray:
    values = np.clip(values, 0.0, 1.0)
    if profile == "adobe_rgb":
        return values ** (1 / GAMMA)
    return np.where(values <= 0.0031308, values * 12.92, 1.055 * values ** (1 / 2.4) - 0.055)


def convert(pixels: np.ndarray, source: str, target: str) -> np.ndarray:
    """Bytes ``(..., 3)`` in another profile, rounded half up; equal profiles change nothing."""
    if source == target:
        return pixels
    table, mixed = _conversion(source, target)
    return np.floor(encoded(table[pixels] @ mixed, target) * 255 + 0.5).astype(np.uint8)


@cache
def _conversion(source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes without the source's curve, and the matrix for rows of pixels."""
    return linear(np.arange(256) / 255.0, source), matrix(source, target).T


def icc_profile(profile: str) -> bytes:
    """A version 2 display profile: adapted primaries, one exponent for all channels, white and names."""
    cone = BRADFORD @ np.array(_xyz(*WHITE))
    adapt = np.linalg.solve(BRADFORD, np.diag(BRADFORD @ np.array(D50) / cone) @ BRADFORD)
    fixed = lambda v: struct.pack(">i", round(float(v) * 65536))
    xyz = lambda v: b"XYZ \0\0\0\0" + b"".join(map(fixed, v))
    name = f"{profile} compatible".encode() + b"\0"
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(GAMMA * 256))
    columns = adapt @ to_xyz(profile)
    tags = [
        (b"desc", b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name + b"\0" * 78), (b"cprt", b"text\0\0\0\0public domain\0"), (b"wtpt", xyz(D50)),
        *[(k, xyz(columns[:, n])) for n, k in enumerate((b"rXYZ", b"gXYZ", b"bXYZ"))], *[(k, curve) for k in (b"rTRC", b"gTRC", b"bTRC")],
    ]
    at, places, body = 128 + 4 + 12 * len(tags), [], b""
    for key, data in tags:
        places.append(key + struct.pack(">II", at + len(body), len(data)))
        body += data + b"\0" * (-len(data) % 4)
    head = struct.pack(">I4sI4s4s4s12s4s4sIII8sI12s", at + len(body), b"\0" * 4, 0x02100000, b"mntr", b"RGB ", b"XYZ ", struct.pack(">6H", 2024, 1, 1, 0, 0, 0), b"acsp", b"\0" * 4, 0, 0, 0, b"\0" * 8, 0, b"".join(map(fixed, D50)))
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + b"".join(places) + body


def png(pixels: np.ndarray, icc: bytes | None = None) -> bytes:
    """An eight-bit RGB image; each row is stored as differences to the pixel before it."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    rows[:, 0] = 1
    flat = pixels.reshape(height, -1)
    rows[:, 1:4] = flat[:, :3]
    rows[:, 4:] = flat[:, 3:] - flat[:, :-3]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    profile = b"" if icc is None else chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + profile + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def tiff(pixels: np.ndarray, icc: bytes | None = None) -> bytes:
    """An uncompressed eight-bit RGB image in one strip, its directory behind the pixels."""
    height, width, _ = pixels.shape
    data = pixels.tobytes()
    data += b"\0" * (len(data) % 2)
    bits, profile = 8 + len(data), 8 + len(data) + 6
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, bits), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 4, 1, height), (279, 4, 1, 3 * width * height)]
    entries += [(34675, 7, len(icc), profile)] if icc else []
    extra = struct.pack("<3H", 8, 8, 8) + (icc or b"") + b"\0" * (len(icc or b"") % 2)
    listed = b"".join(struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 and n == 1 else struct.pack("<I", value)) for tag, kind, n, value in entries)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(extra)) + data + extra + struct.pack("<H", len(entries)) + listed + b"\0" * 4


WRITERS = {"png": png, "tiff": tiff}


def rendered(photos: DataFrame, form: str = "png", profile: str = "srgb", source: str = "srgb", key: str = "photo") -> DataFrame:
    """``(key, content, error)``: each photo's pixels in a profile and a file format."""
    if form not in WRITERS or profile not in PROFILES:
        raise ValueError("unknown form or profile")
    kind = photos.schema[key].dataType.simpleString()
    icc = icc_profile(profile) if PROFILES[profile] else None

    def one(width: int | None, height: int | None, pixels: bytes | None) -> tuple[bytes | None, str | None]:
        if not width or not height or min(width, height) < 1 or len(pixels or b"") != 3 * width * height:
            return None, "pixels do not fill the size"
        return WRITERS[form](convert(np.frombuffer(pixels, np.uint8).reshape(height, width, 3), source, profile), icc), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(w, h, p.as_py()) for w, h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=[key, "content", "error"])

    return photos.select(key, "width", "height", "pixels").mapInArrow(run, f"`{key}` {kind}, content binary, error string")


def _converted(pixels: pa.Array, source: str, target: str) -> list[bytes | None]:
    """Photos' bytes in another profile; small photos are converted together, some ``TOGETHER`` bytes at a time."""
    out: list[bytes | None] = []
    held: list[bytes | None] = []
    size = 0

    def flush() -> None:
        done = convert(np.frombuffer(b"".join(p or b"" for p in held), np.uint8).reshape(-1, 3), source, target).tobytes()
        at = 0
        for p in held:
            out.append(None if p is None else done[at : at + len(p)])
            at += len(p or b"")
        held.clear()

    for value in pixels:
        photo = value.as_py()
        if photo and len(photo) % 3:
            raise ValueError("pixels of three bytes are required")
        held.append(photo)
        size += len(photo or b"")
        if size >= TOGETHER:
            flush()
            size = 0
    flush()
    return out


def converted(photos: DataFrame, source: str, target: str, key: str = "photo") -> DataFrame:
    """``photos`` with their ``pixels`` in another profile; a null stays null."""
    kind = photos.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_converted(batch.column(3), source, target), pa.binary())], names=[key, "width", "height", "pixels"])

    return photos.select(key, F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInArrow(run, f"`{key}` {kind}, width int, height int, pixels binary")


def export(photos: DataFrame, pixels: DataFrame, folder: str, form: str = "png", profile: str = "srgb") -> DataFrame:
    """Write the copies of a photo table (``raw_path``, ``jpg_path``) below ``folder`` by ``render_manifest``; return failures ``(source, error)``.

    ``pixels`` has each source's ``photo``, ``width``, ``height`` and ``pixels``. Files are moved into place whole, so a retry writes the same.
    """
    wanted = render_manifest(photos, ".", form, profile=profile).select("source", F.regexp_replace("destination", r"^\./", "").alias("file"))
    made = rendered(pixels, form, profile).withColumnRenamed("photo", "source")
    joined = wanted.join(made, "source", "left")
    write_files(joined.where("content is not null").select("file", "content"), folder)
    return joined.where("content is null").select("source", F.coalesce("error", F.lit("no pixels")).alias("error"))
