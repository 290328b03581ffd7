import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.operators.library import duplicates, exports, lut, pairing, picks, review, signals
from quillspark.sources.photos import scan_photos


def test_pairing_ignores_case_and_keeps_singles(spark):
    df = spark.createDataFrame([(p,) for p in ("a/X.CR3", "a/x.JPG", "a/y.nef", "b/x.jpeg", "a/z.txt", "noext", "a/.dng", "a/p.q.DNG")], "path string")
    got = {(r.dir, r.stem_key): (r.raw_path, r.jpg_path) for r in pairing.pair_photos(pairing.files(df)).collect()}
    assert got == {("a", "x"): ("a/X.CR3", "a/x.JPG"), ("a", "y"): ("a/y.nef", None), ("b", "x"): (None, "b/x.jpeg"), ("a", "p.q"): ("a/p.q.DNG", None)}


def test_scan_finds_files_in_subfolders(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jpg").write_bytes(b"x")
    (tmp_path / "b.dng").write_bytes(b"yy")
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in scan_photos(spark, str(tmp_path)).collect()} == {("a.jpg", 1), ("b.dng", 2)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (200, 200), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_cosine_join_is_exact(spark, threshold, monkeypatch):
    monkeypatch.setattr(duplicates, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(1, 8)), 50, axis=0) + 0.05 * rng.normal(size=(50, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    got = {(r.a, r.b) for r in duplicates.cosine_pairs(df, threshold, pivots=6).collect()}
    unit = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= threshold)) if i < j}
    assert got == want and want


def test_gates_come_before_ranking_and_ratios_round_up(spark):
    photos = spark.createDataFrame([(k, float(k)) for k in range(10)] + [(10, None)], "photo_id long, s double")
    gated = picks.hard_gate(photos, photos.where("photo_id = 9"))
    picked = picks.ratio_picks(gated, 38, F.col("s"), "photo_id")
    assert [tuple(r) for r in picked.select("photo_id", "pick_rank").orderBy("pick_rank").collect()] == [(8, 1), (7, 2), (6, 3), (5, 4)]
    groups = spark.createDataFrame([(1, "g", False, 9), (2, "g", True, 5), (3, "h", False, 1), (4, "i", None, 1)], "photo_id long, g string, ok boolean, q int")
    best = picks.best_of_group(groups, "g", F.col("ok"), F.col("q").desc())
    assert [r.photo_id for r in best.where("is_best").collect()] == [2]


def test_persona_never_reaches_gates(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.5, None)], "a double, p double")
    assert [r[0] for r in df.select(picks.assisted_order(F.col("a"), F.col("p"), 0.5)).collect()] == [0.5, 0.5]


def test_bursts_of_a_hot_key_over_many_ranges(spark):
    rng = random.Random(2)
    rows = sorted({(k, t) for k, n in (("hot", 3000), ("a", 40), ("z", 1), (None, 30)) for t in rng.sample(range(20_000), n)}, key=lambda r: (r[0] or "", r[1]))
    want, before = Counter(), {}
    for k, t in rows:
        want[k] += k not in before or t - before[k] > 9
        before[k] = t
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(name, value)
    try:
        shots = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "k string, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
        got = duplicates.bursts(shots, "k", "ts", 9, "id").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [(r.k, r.t) for r in got] == rows and Counter({k: max(r.burst_no for r in got if r.k == k) for k in want}) == want
    for one, two in zip(got, got[1:]):
        if one.k == two.k:
            assert two.burst_no - one.burst_no == (two.t - one.t > 9)


def test_bursts_break_at_gaps(spark):
    df = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1), ('a', timestamp'2024-01-01 00:00:10', 2), ('a', timestamp'2024-01-01 00:00:21', 3) t(k, ts, id)")
    assert [r.burst_no for r in duplicates.bursts(df, "k", "ts", 10, "id").orderBy("id").collect()] == [1, 1, 2]


def test_signals(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1, 2.5, 0.0, "portrait"), (2, 0.1, 0.3, 1.5, 0.2, "landscape"), (3, None, None, None, None, None)], "photo_id long, eye_open double, focus double, exposure double, clipped double, scene string")
    got = {r.photo_id: [(f.code, f.severity) for f in r.findings] for r in signals.findings(df).collect()}
    assert got == {1: [("closed_eye", "heavy"), ("missed_focus", "heavy"), ("exposure", "heavy")], 2: [("exposure", "heavy"), ("lost_detail", "review")], 3: []}
    fused = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double").select(signals.fused_score(F.col("a"), F.col("b")))
    assert [r[0] for r in fused.collect()] == [1.0, None]

    def load():
        return lambda batch: batch.assign(y=batch.x * 2)

    assert [r.y for r in signals.batch_inference(spark.range(3).selectExpr("cast(id as double) x"), load, "x double, y double").collect()] == [0.0, 2.0, 4.0]


def test_people_and_review(spark):
    auto = spark.createDataFrame([(1, 7), (2, 8)], "face_id long, person_id int")
    manual = spark.createDataFrame([(2, 9), (5, 3)], "face_id long, person_id int")
    assert {tuple(r) for r in review.overridden(auto, manual, "face_id", "person_id").select("face_id", "person_id").collect()} == {(1, 7), (2, 9), (5, 3)}
    df = spark.createDataFrame([("keep", 0), ("maybe", 6), (None, 5)], "m string, r int")
    assert [tuple(r) for r in df.select(review.mark(F.col("m")), review.rating(F.col("r"))).collect()] == [("keep", None), ("unmarked", None), ("unmarked", 5)]
    hits = review.filtered(spark.range(10), [F.col("id") == 1, F.col("id") > 7], [F.col("id") != 9])
    assert sorted(r.id for r in hits.collect()) == [1, 8]


def test_manifests_and_cache(spark):
    photos = spark.createDataFrame([("a/x.CR3", "a/x.jpg", 3), (None, "b/x.jpg", 9)], "raw_path string, jpg_path string, rating int")
    moved = exports.transfer_manifest(photos, "/t/", move=True)
    assert {tuple(r) for r in moved.select("source", "destination").collect()} == {("a/x.CR3", "/t/x.CR3"), ("a/x.jpg", "/t/x.jpg"), ("a/x.xmp", "/t/x.xmp"), ("b/x.jpg", "/t/x.jpg")}
    assert [tuple(r) for r in exports.collisions(moved).collect()] == [("/t/x.jpg", 2)]
    assert {tuple(r) for r in exports.rating_manifest(photos).collect()} == {("a/x.xmp", "xmp", 3), ("a/x.jpg", "metadata", 3)}
    assert 'xmp:Rating="3"' in photos.select(exports.xmp(F.lit(3))).first()[0]
    rendered = exports.render_manifest(photos, "/t", "tiff", 80, "adobe_rgb").first()
    assert rendered.destination == "/t/x.tif" and rendered.quality is None and rendered.icc
    with pytest.raises(ValueError):
        exports.render_manifest(photos, "/t", "jpeg", 101)
    cache = spark.createDataFrame([("m", 1, 5), ("m", 2, 5), ("n", 1, 5)], "mode string, t int, bytes long")
    assert [(r.mode, r.t) for r in exports.evict(cache, 5, "mode", "t", "t").collect()] == [("m", 1)]
    assert {tuple(r) for r in exports.cache_size(cache).collect()} == {("m", 2, 10), ("n", 1, 5)}


def test_lut_blend(spark, tmp_path):
    path = tmp_path / "x.cube"
    rows = [f"{1 - r} {1 - g} {1 - b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    path.write_text("TITLE \"inverse\"\nLUT_3D_SIZE 2\n" + "\n".join(rows) + "\n")
    table = lut.read_cube(spark, str(path))
    pixels = spark.createDataFrame([(0.25, 0.5, 1.0)], "r double, g double, b double")
    assert np.allclose(lut.blend(pixels, table, 1.0).first(), (0.75, 0.5, 0.0))
    assert np.allclose(lut.blend(pixels, table, 0.5).first(), (0.5, 0.5, 0.5))
    path.write_text("LUT_3D_SIZE 2\n0 0 0\n")
    with pytest.raises(ValueError):
        lut.read_cube(spark, str(path))
