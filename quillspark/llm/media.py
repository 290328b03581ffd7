"""Media columns: signatures are sniffed, structures validated, declared types corrected, embedded media carved.

An Aho-Corasick automaton finds all magic bytes of a value in one pass. Each
candidate is confirmed by its format's validator, which follows the format's own
lengths and checksums and returns the exact extent; what cannot be followed to
its end is not reported. A candidate at offset 0 that spans the value is its type.
Candidates inside an already confirmed medium are reported too, as embedded.

Null values have no type and no media; empty values likewise. Overlapping
candidates are all reported, ordered by offset and type. Repeated rows get equal results;
an empty table gives an empty result. Values are read whole: end markers and block chains
are found once for all candidates of a value, so many candidates do not read it many times.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import utf8

FRAME = 576
RATE = 8000


class Medium(NamedTuple):
    offset: int
    type: str
    length: int


class Value(bytes):
    """A value with what its validators share: places of markers, and where chains of GIF blocks and Ogg pages end."""

    def places(self, marker: bytes) -> list[int]:
        known = self.__dict__.setdefault("_places", {})
        if marker not in known:
            known[marker] = [m.start() for m in re.finditer(re.escape(marker), self)]
        return known[marker]

    def next(self, marker: bytes, at: int) -> int:
        """The first place of a marker from ``at`` on, or -1."""
        found = self.places(marker)
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def last(self, marker: bytes, at: int, end: int) -> int:
        """The last place of a marker from ``at`` on and before ``end``, or -1."""
        found = self.places(marker)
        k = bisect_left(found, end)
        return found[k - 1] if k and found[k - 1] >= at else -1

    def after_blocks(self, at: int) -> int:
        """The end of a chain of length-prefixed blocks; chains that meet are followed once."""
        known, passed = self.__dict__.setdefault("_chains", {}), []
        while at < len(self) and self[at] and at not in known:
            passed.append(at)
            at += self[at] + 1
        end = known.get(at, at + 1)
        known.update(dict.fromkeys(passed, end))
        return end

    def after_pages(self, at: int) -> int:
        """The end of the first page flagged as the last, from a page on, or -1; chains that meet are followed once."""
        known, passed, end = self.__dict__.setdefault("_pages", {}), [], -1
        while at not in known and at + 27 <= len(self) and self[at : at + 5] == b"OggS\0":
            passed.append(at)
            following = at + 27 + self[at + 26] + sum(self[at + 27 : at + 27 + self[at + 26]])
            if following > len(self):
                break
            if self[at + 5] & 4:
                end = following
                break
            at = following
        else:
            end = known.get(at, -1)
        known.update(dict.fromkeys(passed, end))
        return end


def _png(b: Value, at: int) -> tuple[str, int] | None:
    end = at + 8
    while end + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, end)
        stop = end + 12 + size
        if end == at + 8 and (size, kind) != (13, b"IHDR"):
            return None
        if stop > len(b) or zlib.crc32(memoryview(b)[end + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", stop - at
        end = stop
    return None


def _jpeg(b: Value, at: int) -> tuple[str, int] | None:
    end = at + 2
    while end + 4 <= len(b):
        if b[end] != 0xFF:
            return None
        mark, size = b[end + 1], struct.unpack_from(">H", b, end + 2)[0]
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return None
        end += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the end-of-image marker
            stop = b.next(b"\xff\xd9", end)
            return None if stop < 0 else ("image/jpeg", stop + 2 - at)
    return None


def _gif(b: Value, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    end = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while end < len(b):
        if b[end] == 0x3B:
            return "image/gif", end + 1 - at
        if b[end] == 0x21:
            end = b.after_blocks(end + 2)
        elif b[end] == 0x2C and end + 10 <= len(b):
            flags = b[end + 9]
            end = b.after_blocks(end + 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1)
        else:
            return None
    return None


def _riff(b: Value, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(form)
    stop = at + 8 + size
    if not kind or size < 4 or stop > len(b):
        return None
    end = at + 12
    while end < stop:  # chunks, padded to even lengths, must fill the form
        if end + 8 > stop:
            return None
        end += 8 + struct.unpack_from("<I", b, end + 4)[0]
        end += (end - at) & 1
    return (kind, stop - at) if end == stop else None


def _bmp(b: Value, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, _, data, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", size) if header in (12, 40, 52, 56, 108, 124) and 14 + header <= data <= size <= len(b) - at else None


def _gzip(b: Value, at: int) -> tuple[str, int] | None:
    flow = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            flow.decompress(b[k : k + (1 << 16)])
            if flow.eof:
                return "application/gzip", min(k + (1 << 16), len(b)) - len(flow.unused_data) - at
    except zlib.error:
        pass
    return None


def _zip(b: Value, at: int) -> tuple[str, int] | None:
    end = b.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    if start + size != end - at or size and b[at + start : at + start + 4] != b"PK\x01\x02" or end + 22 + note > len(b):
        return None
    return "application/zip", end + 22 + note - at


def _pdf(b: Value, at: int) -> tuple[str, int] | None:
    """Up to the last end marker before the next header: a file that was added to has several."""
    following = b.next(b"%PDF-", at + 1)
    end = b.last(b"%%EOF", at, len(b) if following < 0 else following)
    return ("application/pdf", end + 5 - at) if end > 0 and b.last(b"startxref", at, end) >= 0 else None


def _ogg(b: Value, at: int) -> tuple[str, int] | None:
    """From a page that is flagged as the first up to one that is flagged as the last; each states its segments' sizes."""
    end = b.after_pages(at) if at + 27 <= len(b) and b[at + 5] & 2 else -1
    return None if end < 0 else ("application/ogg", end - at)


# Magic bytes and the validators of their formats.
SIGNATURES: list[tuple[bytes, Callable[[Value, int], tuple[str, int] | None]]] = [
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"\xff\xd8\xff", _jpeg),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"RIFF", _riff),
    (b"BM", _bmp),
    (b"\x1f\x8b\x08", _gzip),
    (b"PK\x03\x04", _zip),
    (b"%PDF-", _pdf),
    (b"OggS\0", _ogg),
]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (len(magic), k))
    found.make_automaton()
    return found


def sniff(value: bytes | None) -> list[Medium]:
    """All confirmed media of a value, by offset; the first at offset 0 may be the value itself."""
    if not value:
        return []
    view, out = Value(value), []
    for last, (size, k) in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - size
        if found := SIGNATURES[k][1](view, at):
            out.append(Medium(at, *found))
    return sorted(out)


def sniff_media(df: DataFrame, id_col: str, value_col: str, declared_col: str | None = None) -> DataFrame:
    """``(id_col, declared, type, media)``: the corrected type (null if unknown) and every medium carved, by offset."""
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("offset", pa.int64()), ("type", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(v.as_py()) for v in batch.column(2)]
            types = [corrected(d, f, v) for d, f, v in zip(batch.column(1).to_pylist(), found, _lengths(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array([[m._asdict() for m in f] for f in found], pa.list_(item))],
                names=[id_col, "declared", "type", "media"],
            )

    declared = F.col(declared_col) if declared_col else F.lit(None)
    return df.select(id_col, declared.cast("string").alias("declared"), F.col(value_col).cast("binary").alias("value")).mapInArrow(
        run, f"`{id_col}` {kind}, declared string, type string, media array<struct<offset:long,type:string,length:long>>"
    )


def _lengths(values: pa.Array) -> list[int]:
    return [len(v.as_py() or b"") for v in values]


def corrected(declared: str | None, found: list[Medium], size: int) -> str | None:
    """The type of a medium that fills the whole value, else what was declared."""
    return next((m.type for m in found if m.offset == 0 and m.length == size), declared)


def pad(text: bytes, frame: int = FRAME) -> bytes:
    """The text with bytes 255 appended up to a positive multiple of the frame."""
    return text + b"\xff" * (max(frame, -(-len(text) // frame) * frame) - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a WAV file; the samples are stored as they are."""
    odd = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + odd


def read_wav(stored: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    end = 12
    while end + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, end)
        if kind == b"data":
            return stored[end + 8 : end + 8 + size]
        end += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: each text's padded bytes as the samples of a WAV file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _lengths(batch.column(1))
            stored = pa.array([to_wav(pad(v.as_py())) for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), stored], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def sample_feature(samples: bytes) -> str:
    """Integer statistics of 8-bit samples: count, sum, least, greatest, distinct values, sum of absolute steps."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "n=0"
    counts = np.bincount(x, minlength=256)
    used = np.flatnonzero(counts)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"n={len(x)} sum={int(counts @ np.arange(256))} min={used[0]} max={used[-1]} distinct={len(used)} steps={steps}"


def describe_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored media, from the bytes read back through the sniffed container."""
    kind = stored.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                media = value.as_py()
                found = sniff(media)
                kind = corrected("application/octet-stream", found, len(media))
                if kind != "audio/wav":
                    raise ValueError(f"stored medium is {kind}")
                payload = read_wav(media)
                inside = ",".join(f"{m.offset}:{m.type}:{m.length}" for m in found if m.offset)
                rows.append((
                    n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
                    hashlib.sha256(media).hexdigest(), f"{kind} {sample_feature(payload)} embedded={inside}",
                ))
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=names)

    return stored.select(id_col, "n_bytes", "media").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op5_media(docs: DataFrame) -> DataFrame:
    return describe_media(store_texts(docs))
