"""Photo files: headers, previews, ratings, rendered copies."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators.library import exif, exports, previews, ratings, render
from quillspark.sources.ordered_text import write_ordered

# A hand-made header: big-endian, make at 50, orientation in place, the next directory at 56 with a rational at 74.
HAND = (
    b"MM\0\x2a\0\0\0\x08" b"\0\x03" b"\x01\x0f\0\2\0\0\0\6\0\0\0\x32" b"\x01\x12\0\3\0\0\0\1\0\6\0\0" b"\x87\x69\0\4\0\0\0\1\0\0\0\x38" b"\0\0\0\0"
    b"Canon\0" b"\0\1" b"\x82\x9a\0\5\0\0\0\1\0\0\0\x4a" b"\0\0\0\0" b"\0\0\0\1\0\0\0\x7d"
)


def jpeg(width, height, *middle, data=b"scan data"):
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe0\0\x04JF" + b"".join(middle) + frame + b"\xff\xda\0\x04\1\2" + data + b"\xff\xd9"


def test_a_hand_made_header():
    assert exif.fields_of(HAND) | {"error": None} == dict.fromkeys([n for n, *_ in exif.FIELDS]) | {"make": "Canon", "orientation": 6, "exposure_seconds": 1 / 125, "error": None}
    inside = jpeg(4, 4, exif.exif_segment(HAND))
    assert exif.fields_of(inside)["make"] == "Canon"


@pytest.mark.parametrize("order", "<>")
def test_packed_headers_come_back(order):
    main = {exif.MODEL: (2, "M é"), exif.ORIENTATION: (3, [8]), exif.TIME: (2, "2024:01:02 03:04:05")}
    inner = {exif.EXPOSURE: (5, ["1/3"]), exif.ISO: (3, [400]), exif.FOCAL: (5, [50]), exif.APERTURE: (5, ["2.8"])}
    got = exif.fields_of(exif.pack(main, inner, order))
    assert (got["model"], got["orientation"], got["taken"], got["exposure_seconds"], got["iso"], got["focal_mm"], got["f_number"]) == ("M é", 8, "2024:01:02 03:04:05", 1 / 3, 400, 50.0, 2.8)


def test_damaged_headers_are_refused_or_read_in_part():
    good = bytearray(exif.pack({exif.MAKE: (2, "a long make"), exif.ORIENTATION: (3, [1])}))
    loop = bytes(good[:34]) + struct.pack("<I", 8) + bytes(good[38:])
    for data, error in ((b"", "no TIFF header"), (b"II*\0\xff\xff\0\0", "directory outside the data"), (loop, "directories form a loop"), (good[:12], "directory outside the data"), (b"\xff\xd8\xff\xd9", "no Exif segment"), (None, "no TIFF header")):
        assert exif.fields_of(data if data is None else bytes(data)) == {"error": error}, data
    cut = exif.fields_of(bytes(good[:-5]))  # the text lies outside
    assert cut["make"] is None and cut["orientation"] == 1
    odd = exif.fields_of(exif.pack({exif.ORIENTATION: (3, [77]), exif.MAKE: (3, [5]), exif.EXPOSURE: (5, [0])}))
    assert odd["orientation"] is None and odd["make"] == "5" and odd["exposure_seconds"] == 0.0
    chain = b"II*\0\x08\0\0\0" + b"".join(b"\0\0" + struct.pack("<I", 8 + 6 * (k + 1)) for k in range(1000))
    assert exif.fields_of(chain) == {"error": "too many directories"}
    zero = bytearray(HAND)
    zero[-4:] = b"\0\0\0\0"
    assert exif.fields_of(bytes(zero))["exposure_seconds"] is None


def test_exif_table(spark):
    rows = [("a", jpeg(1, 1, exif.exif_segment(exif.pack({exif.TIME: (2, "2024:02:30 00:00:00")})))), ("b", exif.pack({exif.TIME: (2, "2024:02:29 10:11:12")})), ("b", None), (None, b"text")]
    got = exif.read_exif(spark.createDataFrame([(*r, "x") for r in rows], "path string, content binary, error string")).collect()
    assert [(r.path, r.taken and r.taken.isoformat(), r.error) for r in got] == [("a", None, None), ("b", "2024-02-29T10:11:12", None), ("b", None, "no TIFF header"), (None, None, "no TIFF header")]
    assert exif.read_exif(spark.createDataFrame([], "path string, content binary")).count() == 0


def container(*streams, orientation=1, order="<", lie=0):
    """A raw file with its streams behind a header that points at them."""
    main = {exif.ORIENTATION: (3, [orientation]), exif.PREVIEW: (4, [0] * len(streams)), exif.PREVIEW_BYTES: (4, [len(s) for s in streams])}
    at = len(exif.pack(main, order=order)) + lie
    starts = [at + sum(map(len, streams[:k])) for k in range(len(streams))]
    return exif.pack(main | {exif.PREVIEW: (4, starts)}, order=order) + b"".join(streams)


@pytest.mark.parametrize("order", "<>")
def test_the_largest_sound_preview_counts(order):
    small, large, torn = jpeg(10, 20), jpeg(300, 200, exif.exif_segment(exif.pack({exif.ORIENTATION: (3, [3])})), data=b"large"), jpeg(900, 900)[:-1]
    width, height, turn, stream, error = previews.preview_of(container(small, large, torn, orientation=6, order=order))
    assert (width, height, turn, error) == (200, 300, 6, None)
    assert exif.fields_of(stream)["orientation"] == 6 and stream.count(b"Exif\0\0") == 1 and stream.endswith(b"large\xff\xd9") and previews.frame_size(stream) == (300, 200)
    assert previews.with_orientation(stream, 6) == stream
    assert previews.preview_of(container(small, order=order, lie=1))[4] == "no sound preview" and previews.preview_of(container(small, order=order, lie=1 << 30))[4] == "no sound preview"
    assert previews.preview_of(b"II")[4] == "no TIFF header" and previews.preview_of(None)[4] == "no TIFF header"


def test_previews_in_a_single_strip():
    stream = jpeg(8, 6)
    head = {exif.COMPRESSION: (3, [6]), exif.STRIPS: (4, [0]), exif.STRIP_BYTES: (4, [len(stream)])}
    at = len(exif.pack(head))
    assert previews.preview_of(exif.pack(head | {exif.STRIPS: (4, [at])}) + stream)[:2] == (8, 6)


def test_cache_is_filled_with_what_it_lacks(spark):
    files = spark.createDataFrame([("a", container(jpeg(3, 2))), ("b", b"bad"), ("c", container(jpeg(5, 4), orientation=8))], "path string, content binary")
    cache = previews.fill_cache(files.where("path <> 'c'"), spark.createDataFrame([], "path string, engine_version int"))
    more = previews.fill_cache(files, cache)
    assert [(r.path, r.width, r.height, r.error) for r in cache.orderBy("path").collect()] == [("a", 3, 2, None), ("b", None, None, "no TIFF header")]
    assert [(r.path, r.width, r.height, r.engine_version) for r in more.collect()] == [("c", 4, 5, 1)]
    assert previews.fill_cache(files, cache.unionByName(more)).count() == 0 and previews.fill_cache(files, cache, version=2).count() == 3


def parts(data):
    return [(m, bytes(data[s:e])) for m, s, e in exif.segments(data) if data[s : s + len(ratings.MARK)] != ratings.MARK]


def test_ratings_leave_all_else_as_it_is():
    plain = jpeg(4, 4, exif.exif_segment(HAND), b"\xff\xfe\0\x05abc", data=b"\xff\x00 image")
    for rating in (0, 3, 5):
        out = ratings.rated_jpeg(plain, rating)
        assert ratings.rating_of(out) == rating and parts(out) == parts(plain) and out.endswith(b"\xff\x00 image\xff\xd9")
        assert ratings.rated_jpeg(out, rating) == out and ratings.rated_jpeg(ratings.rated_jpeg(plain, 1), rating) == out
    first = [m for m, _, _ in exif.segments(ratings.rated_jpeg(plain, 2))]
    assert first == [0xE0, 0xE1, 0xE1, 0xFE, 0xC0, 0xDA]


@pytest.mark.parametrize("packet", [
    b"<rdf:Description xmp:Rating='1' dc:title=\"t\"/>", b"<rdf:Description><xmp:Rating>2</xmp:Rating><x>xmp</x></rdf:Description>", b'<rdf:Description rdf:about="" dc:title="t"></rdf:Description>',
])
def test_ratings_in_packets_that_are_there(packet):
    out = ratings.rated_jpeg(jpeg(4, 4, ratings._segment(packet)), 4)
    assert ratings.rating_of(out) == 4 and out.count(ratings.MARK) == 1
    assert ratings.rated_jpeg(out, 4) == out and (b"dc:title" in out) == (b"dc:title" in packet)


def test_rating_writer_reads_back_as_its_manifest(spark, tmp_path):
    photos = spark.createDataFrame([(f"/lib/{k}.CR3" if k % 2 else None, f"/lib/{k}.jpg" if k % 3 else None, k) for k in range(8)], "raw_path string, jpg_path string, rating int")
    files = spark.createDataFrame([(f"/lib/{k}.jpg", jpeg(k + 1, 2) if k != 4 else b"torn") for k in range(7)], "path string, content binary")
    manifest = exports.rating_manifest(photos)
    for _ in range(2):  # a retry changes nothing
        failed = ratings.write_ratings(manifest, files, str(tmp_path)).collect()
        assert [tuple(r) for r in failed] == [("/lib/4.jpg", "no JPEG")]
        got = {f"/lib/{p.name}": p.read_bytes() for p in (tmp_path / "lib").iterdir()}
        want = {r.target: r.rating for r in manifest.collect() if r.target != "/lib/4.jpg"}
        assert {k: ratings.rating_of(v) for k, v in got.items()} == want and len(want) == 6
        assert parts(got["/lib/2.jpg"]) == parts(jpeg(3, 2)) and [p.name for p in tmp_path.iterdir()] == ["lib"]


def read_png(data):
    """A plain decoder for eight-bit RGB with filters 0 and 1, and the profile."""
    at, body, icc = 8, b"", None
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + chunk) == struct.unpack_from(">I", data, at + 8 + size)[0]
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", chunk)
            assert form == [8, 2, 0, 0, 0]
        body += chunk if kind == b"IDAT" else b""
        icc = zlib.decompress(chunk.split(b"\0", 1)[1][1:]) if kind == b"iCCP" else icc
        at += 12 + size
    rows, out = zlib.decompress(body), []
    for y in range(height):
        line, kind = bytearray(rows[y * (3 * width + 1) + 1 : (y + 1) * (3 * width + 1)]), rows[y * (3 * width + 1)]
        for k in range(3, len(line) if kind else 0):
            line[k] = (line[k] + line[k - 3]) & 255
        out.append(line)
    return np.frombuffer(b"".join(map(bytes, out)), np.uint8).reshape(height, width, 3), icc


def read_tiff(data):
    found = exif.walk(data)[0]
    (width,), (height,), (at,), (size,) = (found[t] for t in (256, 257, 273, 279))
    assert (found[258], found[259], found[262], found[277]) == ((8, 8, 8), (1,), (2,), (3,))
    return np.frombuffer(data[at : at + size], np.uint8).reshape(height, width, 3), found.get(34675, (None,))[0]


def test_files_hold_their_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {f"/l/{k}.CR3": rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for k, (h, w) in enumerate([(1, 1), (5, 7), (64, 3)])}
    rows = [(n, p.shape[1], p.shape[0], p.tobytes()) for n, p in images.items()] + [("/l/short.CR3", 2, 2, b"123"), ("/l/none.CR3", None, 2, None)]
    pixels = spark.createDataFrame(rows, "photo string, width int, height int, pixels binary")
    photos = spark.createDataFrame([(n, None) for n in [*images, "/l/short.CR3", "/l/none.CR3", "/l/lost.CR3"]], "raw_path string, jpg_path string")
    for form, ending, read in (("png", "png", read_png), ("tiff", "tif", read_tiff)):
        for profile in ("srgb", "adobe_rgb"):
            failed = render.export(photos, pixels, str(tmp_path / form / profile), form, profile)
            assert {r.source: r.error for r in failed.collect()} == {"/l/short.CR3": "pixels do not fill the size", "/l/none.CR3": "pixels do not fill the size", "/l/lost.CR3": "no pixels"}
            for name, image in images.items():
                got, icc = read((tmp_path / form / profile / f"{name[3:-4]}.{ending}").read_bytes())
                assert (got == render.convert(image, "srgb", profile)).all() and (icc is None) == (profile == "srgb")
                assert icc is None or icc == render.icc_profile("adobe_rgb")
    with pytest.raises(ValueError):
        render.rendered(pixels, "jpeg")


def test_colours():
    """Known values: the published matrices to four places, white and grey stay neutral, and the way back."""
    assert np.allclose(render.to_xyz("srgb"), [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]], atol=2e-4)
    assert np.allclose(render.to_xyz("adobe_rgb"), [[0.5767, 0.1856, 0.1882], [0.2973, 0.6274, 0.0753], [0.0270, 0.0707, 0.9911]], atol=5e-4)
    every = np.stack(np.meshgrid(*[np.arange(0, 256, 15)] * 3), axis=-1).astype(np.uint8)
    there = render.convert(every, "srgb", "adobe_rgb")
    bright = every.min(axis=-1) >= 60  # eight bits are coarse in the dark
    assert np.abs(render.convert(there, "adobe_rgb", "srgb").astype(int) - every)[bright].max() <= 1
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    out = render.convert(grey, "srgb", "adobe_rgb").astype(int)
    assert (np.ptp(out, axis=1) == 0).all() and out[255, 0] == 255 and out[0, 0] == 0
    assert render.convert(np.array([[255, 0, 0]], np.uint8), "srgb", "adobe_rgb").tolist() == [[219, 0, 0]]


def test_icc_profile_is_well_formed():
    data = render.icc_profile("adobe_rgb")
    size, count = struct.unpack_from(">I", data)[0], struct.unpack_from(">I", data, 128)[0]
    assert size == len(data) and data[36:40] == b"acsp" and data[12:24] == b"mntrRGB XYZ " and count == 9
    tags = {data[132 + 12 * k : 136 + 12 * k]: struct.unpack_from(">II", data, 136 + 12 * k) for k in range(count)}
    assert all(a % 4 == 0 and a + n <= size for a, n in tags.values())
    primaries = sum(np.array(struct.unpack_from(">3i", data, tags[k][0] + 8)) / 65536 for k in (b"rXYZ", b"gXYZ", b"bXYZ"))
    assert np.allclose(primaries, render.D50, atol=1e-3)
    red = np.array(struct.unpack_from(">3i", data, tags[b"rXYZ"][0] + 8)) / 65536
    assert np.allclose(red, [0.6097, 0.3111, 0.0195], atol=1e-3) and struct.unpack_from(">H", data, tags[b"rTRC"][0] + 12)[0] == 563


def test_contents_of_one_name_follow_each_other(spark, tmp_path):
    rows = spark.createDataFrame([("d/x", b"\0\n"), ("d/x", b"\xff"), ("y", b""), ("z", None)], "file string, content binary").coalesce(1)
    write_ordered(rows, str(tmp_path))
    assert (tmp_path / "d/x").read_bytes() == b"\0\n\xff" and (tmp_path / "y").read_bytes() == b"" and (tmp_path / "z").read_bytes() == b""
    assert hashlib.sha256((tmp_path / "d/x").read_bytes()).hexdigest() == hashlib.sha256(b"\0\n\xff").hexdigest()


def test_photos_are_converted_together(monkeypatch):
    """A photo of one pixel costs no conversion of its own: matrices are solved once, whatever the photos."""
    rng = np.random.default_rng(5)
    photos = [rng.integers(0, 256, 3 * n).astype(np.uint8).tobytes() for n in (1, 0, 7, 300, 1, 1)] + [None]
    want = [p if p is None else render.convert(np.frombuffer(p, np.uint8).reshape(-1, 3), "srgb", "adobe_rgb").tobytes() for p in photos]
    calls, convert = [], render.convert
    monkeypatch.setattr(render, "convert", lambda *a: calls.append(1) or convert(*a))
    monkeypatch.setattr(render, "matrix", lambda *a: pytest.fail("solved again"))
    assert render._converted(pa.array(photos, pa.binary()), "srgb", "adobe_rgb") == want and len(calls) == 1
    monkeypatch.setattr(render, "TOGETHER", 900)
    assert render._converted(pa.array(photos, pa.binary()), "srgb", "adobe_rgb") == want and len(calls) == 3
    with pytest.raises(ValueError, match="three bytes"):
        render._converted(pa.array([b"ab"], pa.binary()), "srgb", "adobe_rgb")
