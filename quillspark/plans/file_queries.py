"""Queries over photo files that Spark makes from the given tables: headers, previews, ratings, colours."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.library import exif, previews, ratings, render
from quillspark.operators.library.exports import rating_manifest
from quillspark.plans.counter_queries import read
from quillspark.plans.library_queries import raw_jpg_pairing
from quillspark.plans.state_queries import scratch
from quillspark.sources.ordered_text import read_files


def with_content(rows: DataFrame, make: Callable[..., bytes], key: str) -> DataFrame:
    """``(key, content)``: a file per row, made from the row's other columns."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(*r) for r in zip(*listed)], pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, f"`{key}` {kind}, content binary")


def plain_jpeg(width: int, height: int, *middle: bytes, data: bytes = b"\x11\x22") -> bytes:
    """A JPEG's segments around image data that nobody decodes."""
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe0\0\x04JF" + b"".join(middle) + frame + b"\xff\xda\0\x04\1\2" + data + b"\xff\xd9"


def exif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photos, in both byte orders, every third one a JPEG and every eleventh damaged."""
    def made(key: int, brand: str, size: int, taken: str) -> bytes:
        main = {exif.MAKE: (2, brand), exif.ORIENTATION: (3, [key % 8 + 1])}
        inner = {exif.TAKEN: (2, taken), exif.EXPOSURE: (5, [f"1/{key % 500 + 1}"]), exif.APERTURE: (5, [f"{10 + size % 20}/10"]), exif.ISO: (3, [100 * (size % 8 + 1)])}
        header = exif.pack(main, inner, "<" if key % 2 else ">")
        header = header[:20] if key % 11 == 0 else header
        return plain_jpeg(1, 1, exif.exif_segment(header)) if key % 3 == 0 else header

    taken = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("p_partkey")), "yyyy:MM:dd HH:mm:ss")
    files = with_content(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", taken.alias("taken")), made, "p_partkey")
    return exif.read_exif(files, "p_partkey").select("p_partkey", "make", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "exposure_seconds", "f_number", "iso", "orientation", "error")


def preview_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw files with two previews, the second behind a false pointer for every seventh; cached ones, of even size, are left out."""
    def made(key: int, size: int) -> bytes:
        streams = [plain_jpeg(10 + size, 20, data=b"small"), plain_jpeg(100 + key % 50, 90 + size, data=b"large %d" % key)]
        main = {exif.ORIENTATION: (3, [key % 8 + 1]), exif.PREVIEW: (4, [0, 0]), exif.PREVIEW_BYTES: (4, [len(s) for s in streams])}
        at = len(exif.pack(main))
        starts = [at, at + len(streams[0]) + (3 if key % 7 == 0 else 0)]
        return exif.pack(main | {exif.PREVIEW: (4, starts)}) + b"".join(streams)

    parts = read(spark, sf_dir, "part")
    cache = parts.where("p_size % 2 = 0").select("p_partkey", F.lit(previews.VERSION).alias("engine_version"))
    made_previews = previews.fill_cache(with_content(parts.select("p_partkey", "p_size"), made, "p_partkey"), cache, path_col="p_partkey")
    return made_previews.select("p_partkey", "engine_version", "width", "height", "orientation", F.octet_length("preview").alias("n_bytes"))


def ratings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating manifest of paired photos carried out on made-up JPEGs, and the ratings read back from the files."""
    folder = scratch(spark)
    photos = raw_jpg_pairing(spark, sf_dir).withColumn("rating", F.length("stem_key") % 7)
    files = with_content(photos.where("jpg_path is not null").select(F.col("jpg_path").alias("path"), F.length("jpg_path").alias("n")), lambda path, n: plain_jpeg(n, n, data=path.encode()), "path")
    manifest = rating_manifest(photos)
    ratings.write_ratings(manifest, files, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ratings.rating_of(v.as_py()) for v in batch.column(1)], pa.int32())], names=["target", "rating"])

    # The manifest says which files there are, so the driver need not list them.
    targets = manifest.select("target").distinct().withColumn("file", ratings.place(F.col("target")))
    written = read_files(targets, folder).where("content is not null")
    return written.select(F.concat(F.lit("/"), "file").alias("target"), "content").mapInArrow(run, "target string, rating int")


def rendered_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photos of one pixel, from sRGB to Adobe RGB."""
    channel = lambda c: F.unhex(F.lpad(F.hex(c.cast("long") % 256), 2, "0"))
    key = F.col("p_partkey")
    pixel = F.concat(channel(key), channel(F.col("p_size") * 5), channel(F.floor(F.col("p_retailprice"))))
    photos = read(spark, sf_dir, "part").select(key.alias("photo"), F.lit(1).alias("width"), F.lit(1).alias("height"), pixel.alias("pixels"))
    out = render.converted(photos, "srgb", "adobe_rgb")
    return out.select(F.col("photo").alias("p_partkey"), *[F.conv(F.hex(F.substring("pixels", k + 1, 1)), 16, 10).cast("int").alias(n) for k, n in enumerate("rgb")])


QUERIES = {f.__name__: f for f in (exif_fields, preview_sizes, ratings_written, rendered_colours)}

_M = render.matrix("srgb", "adobe_rgb").tolist()
_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {0} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({0} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_MIXED = ", ".join(f"floor(pow(greatest(0, least(1, {' + '.join(f'{w!r}::DOUBLE * l{c}' for w, c in zip(row, 'rgb'))})), 256 / 563.0::DOUBLE) * 255 + 0.5::DOUBLE)::INT AS {n}" for row, n in zip(_M, "rgb"))
_LINEAR_ALL = ", ".join(f"{_LINEAR.format(c)} AS l{c}" for c in "rgb")

ORACLE_SQL = {
    "exif_fields": """SELECT p_partkey, CASE WHEN ok THEN p_brand END AS make, CASE WHEN ok THEN strftime(TIMESTAMP '2024-01-01' + to_seconds(p_partkey), '%Y-%m-%d %H:%M:%S') END AS taken,
 CASE WHEN ok THEN 1 / (p_partkey % 500 + 1)::DOUBLE END AS exposure_seconds, CASE WHEN ok THEN (10 + p_size % 20) / 10::DOUBLE END AS f_number, CASE WHEN ok THEN 100 * (p_size % 8 + 1) END::INT AS iso,
 CASE WHEN ok THEN p_partkey % 8 + 1 END::INT AS orientation, CASE WHEN NOT ok THEN 'directory outside the data' END AS error FROM (SELECT *, p_partkey % 11 <> 0 AS ok FROM part)""",
    "preview_sizes": """WITH x AS (SELECT *, p_partkey % 7 <> 0 AS sound FROM part WHERE p_size % 2 = 1), y AS (SELECT p_partkey, CASE WHEN sound THEN 100 + p_partkey % 50 ELSE 10 + p_size END AS w, CASE WHEN sound THEN 90 + p_size ELSE 20 END AS h, sound FROM x)
SELECT p_partkey, 1 AS engine_version, CASE WHEN p_partkey % 8 >= 4 THEN h ELSE w END::INT AS width, CASE WHEN p_partkey % 8 >= 4 THEN w ELSE h END::INT AS height, (p_partkey % 8 + 1)::INT AS orientation,
 (2 + 10 + 26 + 6 + 13 + 6 + 2 + CASE WHEN sound THEN 6 + length(p_partkey::VARCHAR) ELSE 5 END)::INT AS n_bytes FROM y""",
    "ratings_written": """WITH p AS (SELECT doc_id, (length('img_' || doc_id) % 7)::INT AS rating, '/lib/' || source || '/IMG_' || doc_id AS stem FROM documents WHERE (doc_id % 4 <> 0 OR doc_id % 3 <> 0) AND length('img_' || doc_id) % 7 <= 5)
SELECT stem || '.xmp' AS target, rating FROM p WHERE doc_id % 4 <> 0 UNION ALL SELECT stem || '.jpg', rating FROM p WHERE doc_id % 3 <> 0""",
    "rendered_colours": f"WITH p AS (SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 % 256 AS g, floor(p_retailprice)::BIGINT % 256 AS b FROM part), q AS (SELECT p_partkey, {_LINEAR_ALL} FROM p) SELECT p_partkey, {_MIXED} FROM q",
}
