"""Ratings written where they belong: into a JPEG's XMP segment, or into a sidecar beside a raw file.

A rating replaces the one in an existing XMP packet and leaves the rest of the packet; without
a packet a new segment is put behind the JPEG's first segments. All other segments and the image data
keep their bytes. Writing the same rating again gives the same bytes, so a retry changes nothing.

Null or damaged content, a packet that cannot take a rating and ratings outside 0 to 5 give an error and no content.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.library.exif import Damaged, segments
from quillspark.operators.library.exports import xmp
from quillspark.operators.durable import durable
from quillspark.sources.ordered_text import write_files

# The marker of XMP segments, and a packet's two ways to hold a rating.
MARK = b"http://ns.adobe.com/xap/1.0/\0"
ATTRIBUTE = re.compile(rb"(\bxmp:Rating\s*=\s*)([\"'])[^\"']*\2")
ELEMENT = re.compile(rb"(<xmp:Rating>)[^<]*(</xmp:Rating>)")
DESCRIPTION = re.compile(rb"<rdf:Description\b")
PACKET = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="%d"/></rdf:RDF></x:xmpmeta>'


def rated_packet(packet: bytes, rating: int) -> bytes:
    """The packet with the rating in place of the one it has, or as a new attribute of its first description."""
    for pattern, by in ((ATTRIBUTE, rb"\g<1>\g<2>%d\g<2>"), (ELEMENT, rb"\g<1>%d\g<2>")):
        out, n = pattern.subn(by % rating, packet)
        if n:
            return out
    names = b"" if b"xmlns:xmp=" in packet else b' xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
    out, n = DESCRIPTION.subn(lambda m: m[0] + names + b' xmp:Rating="%d"' % rating, packet, count=1)
    if not n:
        raise Damaged("XMP packet without a description")
    return out


def rated_jpeg(jpeg: bytes, rating: int) -> bytes:
    if jpeg[:2] != b"\xff\xd8":
        raise Damaged("no JPEG")
    out, put, lead = [jpeg[:2]], False, 1
    for marker, start, end in segments(jpeg):
        piece = jpeg[start - 4 : end]
        if marker == 0xE1 and jpeg[start : start + len(MARK)] == MARK:
            piece, put = _segment(rated_packet(jpeg[start + len(MARK) : end], rating)), True
        elif marker in (0xE0, 0xE1) and len(out) == lead:
            lead += 1  # JFIF and Exif stay in front
        out.append(piece)
    if not put:
        out.insert(lead, _segment(PACKET % rating))
    return b"".join(out)


def _segment(packet: bytes) -> bytes:
    if len(packet) + len(MARK) > 0xFFFF - 2:
        raise Damaged("XMP packet too long")
    return b"\xff\xe1" + struct.pack(">H", len(packet) + len(MARK) + 2) + MARK + packet


def rating_of(content: bytes | None) -> int | None:
    """The rating in a JPEG's XMP segment or in a sidecar's text."""
    packet = content or b""
    if packet[:2] == b"\xff\xd8":
        try:
            packet = next((packet[s + len(MARK) : e] for m, s, e in segments(packet) if m == 0xE1 and packet[s : s + len(MARK)] == MARK), b"")
        except Damaged:
            return None
    found = re.search(rb"\bxmp:Rating\s*=\s*[\"'](-?\d+)[\"']|<xmp:Rating>(-?\d+)</xmp:Rating>", packet)
    return int(found[1] or found[2]) if found else None


def rate(files: DataFrame, path_col: str = "path", content_col: str = "content", rating_col: str = "rating") -> DataFrame:
    """``(path, content, error)``: the JPEGs with their ratings."""
    kind = files.schema[path_col].dataType.simpleString()

    def one(content: bytes | None, rating: int | None) -> tuple[bytes | None, str | None]:
        try:
            if rating is None or not 0 <= rating <= 5:
                raise Damaged("rating outside 0 to 5")
            return rated_jpeg(content or b"", rating), None
        except Damaged as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(c.as_py(), r) for c, r in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=[path_col, "content", "error"])

    return files.select(path_col, content_col, F.col(rating_col).cast("int").alias("rating")).mapInArrow(run, f"`{path_col}` {kind}, content binary, error string")


def place(target: Column) -> Column:
    """Where a target's file lies below the folder: its path without root and scheme."""
    return F.regexp_replace(target, r"^[a-z]*:?/*", "")


def write_ratings(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Carry out a manifest of ``exports.rating_manifest`` below ``folder`` and return its failures ``(target, error)``.

    Sidecars hold nothing but the rating; JPEGs are copies of ``files`` (path, content)
    with it. Each file is moved into place whole, by its path without root and scheme. Of
    several ratings for a target the highest counts; paths of ``files`` are unique.
    """
    manifest = manifest.groupBy("target", "form").agg(F.max("rating").alias("rating"))
    sidecars = manifest.where("form = 'xmp'").select(place(F.col("target")).alias("file"), xmp(F.col("rating")).cast("binary").alias("content"))
    inside = manifest.where("form = 'metadata'").join(files.select(F.col("path").alias("target"), "content"), "target", "left")
    made = durable(rate(inside, "target"))
    write_files(sidecars.unionByName(made.where("content is not null").select(place(F.col("target")).alias("file"), "content")), folder)
    return made.where("error is not null").select("target", "error")
