import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections import Counter
from itertools import pairwise

from quillspark.llm.media import op5_media, pad, read_wav, sniff, sniff_media, to_wav


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 4) + b"cd" + b"\x01\x02\xff\x00\x03\xff\xd9"
    ogg = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x05hello"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF"
    return {"image/png": png(), "application/zip": z.getvalue(), "image/bmp": bmp, "image/gif": gif, "image/jpeg": jpeg, "application/ogg": ogg, "application/pdf": pdf, "application/gzip": gzip.compress(b"hello" * 50), "audio/wav": to_wav(b"\x01\x02\x03")}


def test_each_format_is_confirmed_and_damage_is_not():
    for kind, value in samples().items():
        assert [(m.offset, m.type, m.length) for m in sniff(value) if m.offset == 0] == [(0, kind, len(value))], kind
        inside = sniff(b"junk PNG BM RIFF " + value + b" tail")
        assert (17, kind, len(value)) in [(m.offset, m.type, m.length) for m in inside], kind
        assert not [m for m in sniff(value[: len(value) - 3]) if m.type == kind and m.offset == 0], kind
    broken = bytearray(png())
    broken[20] ^= 1
    assert sniff(bytes(broken)) == [] and sniff(None) == sniff(b"") == sniff(b"BM") == []


def test_a_pdf_that_was_added_to_is_whole_and_two_in_a_row_are_two():
    one = b"%PDF-1.4\nobj\nstartxref\n0\n%%EOF\n"
    added = one + b"more\nstartxref\n9\n%%EOF"
    assert [(m.offset, m.length) for m in sniff(added)] == [(0, len(added))]
    assert [(m.offset, m.length) for m in sniff(one + added)] == [(0, len(one) - 1), (len(one), len(added))]
    assert sniff(b"%PDF-1.4 %%EOF") == []


def test_ogg_streams_in_a_row_and_without_an_end():
    first, middle, last = (b"OggS\0" + bytes([flags]) + b"\0" * 20 + b"\1\3abc" for flags in (2, 0, 4))
    one = first + middle + last
    assert [(m.offset, m.length) for m in sniff(one + b"--" + one)] == [(0, len(one)), (len(one) + 2, len(one))]
    assert [(m.offset, m.length) for m in sniff(first + one)] == [(0, len(first + one)), (len(first), len(one))]
    assert sniff(first + middle) == [] and sniff(middle + last) == [] and sniff(first + last[:-1]) == [] and sniff(first + b"x" + last) == []


def test_time_is_linear_in_the_candidates():
    for unit in (b"%PDF-", b"GIF89a123456!!x", b"\xff\xd8\xff\xda\x00\x02", b"PK\x03\x04", b"OggS\0" + b"\0" * 21 + b"\1\1x", b"OggS\0\2" + b"\0" * 21, b"RIFF\xff\xff\0\0WAVE", b"\x1f\x8b\x08\0\0\0\0\0\0\3", b"%PDF- startxref %%EOF", b"\x89PNG\r\n\x1a\n\0\0\xff\0IDAT"):
        took = []
        for n in (10_000, 20_000, 40_000):
            began = time.process_time()
            sniff(unit * n)
            took.append(time.process_time() - began)
        assert took[2] < 3 * took[1] + 0.2 and took[2] < 3, (unit, took)


def test_declared_types_are_corrected_and_media_carved(spark):
    nested = to_wav(pad(b"x" * 10 + png()))
    rows = [(1, "image/jpeg", png()), (2, "text/plain", b"plain"), (3, None, None), (4, "audio/wav", nested), (None, "a/b", b"")]
    got = {r.id: (r.type, [(m.offset, m.type, m.length) for m in r.media]) for r in sniff_media(spark.createDataFrame(rows, "id long, declared string, v binary"), "id", "v", "declared").collect()}
    assert got == {1: ("image/png", [(0, "image/png", len(png()))]), 2: ("text/plain", []), 3: (None, []), 4: ("audio/wav", [(0, "audio/wav", len(nested)), (54, "image/png", len(png()))]), None: ("a/b", [])}


def test_round_trip_of_every_text(spark, sf_dir, odd_docs, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for table in (docs, odd_docs.select("doc_id", "text")):
        texts = {r.doc_id: r.text for r in table.collect()}
        rows = op5_media(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_bytes % 576 == 0
            counts = Counter(padded)
            plain = f"n={len(padded)} sum={sum(padded)} min={min(padded)} max={max(padded)} distinct={len(counts)} steps={sum(abs(a - b) for a, b in pairwise(padded))}"
            assert r.feature.startswith(f"audio/wav {plain} embedded=")
            assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
            assert read_wav(to_wav(padded)) == padded and r.media_sha256 == hashlib.sha256(to_wav(padded)).hexdigest() and r.media_bytes == len(to_wav(padded))
    same = [r for r in op5_media(odd_docs).collect() if r.doc_id in (4, 5)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert op5_media(make_docs([])).count() == 0
