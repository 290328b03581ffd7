"""Queries over the photo-library operators. The test tables stand in for photos: see each query."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.durable import durable, scratch_root
from quillspark.operators.library import duplicates, exports, linkage, lut, pairing, persona, picks, review, signals
from quillspark.plans.counter_queries import read
from quillspark.sources.ordered_text import write_ordered

PAIR_COSINE, PERSON_COSINE = 0.35, 0.4
GAP_SECONDS = 7200


def photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: three in four numbers have a raw file, two in three a rendered one; some are neither."""
    docs = read(spark, sf_dir, "documents")
    path = lambda ext: F.concat_ws("", F.lit("/lib/"), "source", F.lit("/IMG_"), F.col("doc_id").cast("string"), F.lit(ext))
    made = F.array_compact(F.array(F.when(F.col("doc_id") % 4 != 0, path(".CR3")), F.when(F.col("doc_id") % 3 != 0, path(".jpg")), F.when(F.col("doc_id") % 5 == 0, path(".txt"))))
    return docs.select(F.explode(made).alias("path"))


def raw_jpg_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_photos(pairing.files(photo_files(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), "source", "lang", "n_chars", F.md5("text").alias("digest")).join(
        read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "photo_id"), "photo_id", "left"
    )


def hard_gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels play rejected photos."""
    rejected = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("photo_id"))
    kept = picks.hard_gate(labelled(spark, sf_dir), rejected)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.min("photo_id").alias("first_id"))


def duplicate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are duplicates; toxic ones are unusable; quality ranks."""
    usable = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    best = picks.best_of_group(labelled(spark, sf_dir), "digest", usable, F.col("quality").desc_nulls_last(), F.col("photo_id"))
    return best.where("is_best").select("photo_id", "digest", F.col("quality").cast("bigint").alias("quality"))


def ratio_picks_38(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = labelled(spark, sf_dir).where("coalesce(toxic, 0) = 0")
    score = picks.assisted_order(F.col("n_chars").cast("double"), F.col("quality").cast("double") * 1000)
    return picks.ratio_picks(photos, 38, score, "photo_id").select("photo_id", "pick_rank")


def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = duplicates.bursts(read(spark, sf_dir, "events"), "user_id", "ts", GAP_SECONDS, "event_id")
    return shots.groupBy("user_id", "burst_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.cosine_pairs(read(spark, sf_dir, "embeddings"), PAIR_COSINE).select("a", "b")


def person_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similarity_groups(duplicates.similarity_links(read(spark, sf_dir, "embeddings"), PERSON_COSINE))


def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar images; links, not pairs, lead to them. At this threshold bands of such a recall compare more than all pairs, so all blocks meet once."""
    return duplicates.similarity_groups(duplicates.banded_links(read(spark, sf_dir, "embeddings"), PERSON_COSINE, recall=0.9999, most_visits=160))


LEVELS = (0.4, 0.45, 0.5, 0.6)


def linkage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of single linkage at several cosines, all from one spanning forest."""
    forest = durable(linkage.spanning_forest(linkage.angles(duplicates.representative_pairs(read(spark, sf_dir, "embeddings"), LEVELS[0]))))
    out = None
    for level in LEVELS:
        groups = linkage.level_groups(forest, math.acos(level)).groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(level).alias("cosine"), "component", "n")
        out = groups if out is None else out.unionByName(groups)
    return out


ROUNDS = 6


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photos with a trait of language and length; labels play decisions."""
    kept, rejected = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labelled(spark, sf_dir).withColumns({"trait": F.concat("lang", F.lit(" "), F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).cast("string")), "kept": F.coalesce(kept, F.lit(False)), "rejected": F.coalesce(rejected, F.lit(False))})


def persona_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = persona.contests(traits(spark, sf_dir), "source", "trait", F.col("kept"), F.col("rejected"))
    return persona.strengths(found, rounds=ROUNDS, tolerance=0.0).select("trait", F.round("strength", 6).alias("strength"))


def persona_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persona's score orders what the gate lets through; rejected photos stay out however well they score."""
    photos = traits(spark, sf_dir)
    taste = persona_strengths(spark, sf_dir)
    allowed = picks.hard_gate(photos, photos.where("rejected").select("photo_id"))
    order = picks.assisted_order(F.col("n_chars").cast("double"), F.round(F.col("persona"), 5) * 10_000)
    return picks.ratio_picks(persona.scored(allowed, taste, "trait"), 38, order, "photo_id").select("photo_id", "pick_rank")


def override_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events play decisions on users: the last one counts, error and view leave no mark."""
    log = read(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "signup", "reject"))
    last = review.latest_decisions(log, "user_id", "ts", "event_id")
    return last.select("user_id", "event_id", review.mark(F.col("mark")).alias("mark"), review.rating(F.floor(F.col("value") / 10)).alias("rating"))


def people_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding labels play automatic people; every ninth face is moved by hand, person 3 is merged into 1."""
    faces = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), F.col("label").alias("person_id"))
    manual = faces.where("face_id % 9 = 0").select("face_id", F.lit(100).alias("person_id"))
    merged = review.rename_groups(review.overridden(faces, manual, "face_id", "person_id"), spark.createDataFrame([(3, 1)], "from_id int, to_id int"))
    return merged.groupBy("person_id").agg(F.count("*").alias("faces"), F.min("face_id").alias("first_face"))


def multi_group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face belongs to its photo ``face_id // 4``; photos that show people 1 or 2, with the groups they are in."""
    bridge = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("photo_id"), F.col("label").alias("person_id")).distinct()
    photos = bridge.groupBy("photo_id").agg(F.count("*").alias("groups"))
    return review.photos_of(photos, bridge, F.col("person_id").isin(1, 2))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic, quality = F.col("toxic"), F.col("quality")
    return review.facet_counts(labelled(spark, sf_dir), {
        "n_reject": toxic == 1, "n_keep": (quality == 1) & (toxic == 0), "n_unmarked": quality.isNull(),
        "n_review": (quality == 0) & (toxic == 0), "n_group": F.col("n_chars") > 2000, "n_english_keep": (F.col("lang") == "en") & (quality == 1),
    })


def display_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.neighbours(labelled(spark, sf_dir), "source", "n_chars").select("photo_id", "previous_id", "next_id")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types as wanted previews; those with a purchase-sized value are cached."""
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode"), "value")
    missing = exports.cache_misses(events.select("user_id", "mode").distinct(), events.where("value > 50"), ["user_id", "mode"])
    return missing.groupBy("mode").agg(F.count("*").alias("misses"), F.sum("user_id").alias("user_sum"))


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("mode"), "ts", F.lit(1).cast("bigint").alias("bytes"))
    out = exports.evict(cache, 500, "mode", "ts", "event_id")
    return out.groupBy("mode").agg(F.count("*").alias("evicted"), F.max("event_id").alias("newest_evicted"))


def transfer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.transfer_manifest(raw_jpg_pairing(spark, sf_dir), "/out", move=True)


def rating_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = raw_jpg_pairing(spark, sf_dir).withColumn("rating", F.length("stem_key") % 7)
    return exports.rating_manifest(photos)


def exposure_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances play exposure offsets and clipped shares."""
    photos = read(spark, sf_dir, "customer").select((F.col("c_acctbal") / 4000).alias("offset"), ((F.col("c_custkey") % 20) / 100).alias("clipped"))
    tiers = photos.select(signals.exposure_penalty(F.col("offset"), F.col("clipped")).alias("tier"))
    return tiers.groupBy("tier").agg(F.count("*").alias("n"))


def photo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("photo_id"), ((F.col("p_size") % 10) / 10).alias("eye_open"), ((F.col("p_partkey") % 13) / 12).alias("focus"),
        ((F.col("p_partkey") % 9) / 3).alias("exposure"), ((F.col("p_partkey") % 17) / 100).alias("clipped"),
        F.when(F.col("p_type") == "ECONOMY", "landscape").otherwise("portrait").alias("scene"),
    )
    return signals.findings(photos).select("photo_id", F.array_join("findings.code", ",").alias("codes"), F.array_join("findings.severity", ",").alias("severities"))


def main_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_linenumber").alias("face_id"), F.col("l_extendedprice").alias("subject_score"))
    return signals.main_subject(faces).select("photo_id", "face_id")


def tone_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tones = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), "l_quantity").select(F.year("d").alias("key"), "l_quantity")
    return signals.histogram(tones, "key", "l_quantity", 10, 0.0, 50.0).withColumnRenamed("count", "n")


def graded_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels through a lookup table, one point an axis for each region, written as a .cube file and blended at 0.4.

    The table inverts red, halves green and swaps nothing else, which interpolation keeps exact.
    """
    points = read(spark, sf_dir, "region").count()
    n, top = F.col("id"), points - 1
    line = F.concat_ws(" ", *[c.cast("string") for c in (1 - (n % points) / top, F.floor(n / points) % points / top / 2, F.floor(n / points**2) / top)])
    folder = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    header = f"# graded\nLUT_3D_SIZE {points}\nDOMAIN_MIN 0.0 0.0 0.0\nDOMAIN_MAX 1.0 1.0 1.0"
    write_ordered(spark.range(points**3).orderBy("id").select(line.alias("line")), folder, "look.cube", header)
    key = F.col("p_partkey")
    pixels = read(spark, sf_dir, "part").select("p_partkey", ((key % 256) / 255).alias("r"), (F.col("p_size") / 60).alias("g"), ((key % 101) / 100).alias("b"))
    out = lut.blend(pixels, lut.read_cube(spark, f"{folder}/look.cube"), 0.4)
    return out.select("p_partkey", *[F.round(c, 9).alias(c) for c in "rgb"])


def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photos: a model's score and four detectors', some of which have none."""
    key, size = F.col("p_partkey"), F.col("p_size")
    detectors = [F.when(key % 3 != 0, size / 50), F.when(key % 5 != 0, key % 11 / 10), F.when(key % 7 == 0, F.lit(0.25)), size % 4 / 4]
    return read(spark, sf_dir, "part").select("p_partkey", F.round(signals.fused_score(F.when(key % 2 == 0, F.col("p_retailprice") / 2000), *detectors), 9).alias("score"))


def grouped_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts with their best photo, kept unless a later decision marks another; marks never come from the ranking."""
    photos = labelled(spark, sf_dir)
    usable = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    best = picks.best_of_group(photos, "digest", usable, F.col("quality").desc_nulls_last(), F.col("photo_id"))
    auto = best.select("photo_id", F.when(F.col("is_best"), "keep").otherwise("unmarked").alias("mark"))
    log = read(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("photo_id"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "error", "reject").alias("mark"))
    decided = review.latest_decisions(log, "photo_id", "ts", "event_id").select("photo_id", review.mark(F.col("mark")).alias("mark"))
    marks = review.overridden(auto, decided.join(photos.select("photo_id"), "photo_id", "left_semi"), "photo_id", "mark")
    shown = review.filtered(photos.join(marks, "photo_id"), [F.col("mark") == "keep", F.col("lang") == "de"], [F.col("n_chars") > 200])
    return shown.groupBy("source", "mark").agg(F.count("*").alias("n"), F.min("photo_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (
    graded_colours, fused_scores, grouped_review,
    raw_jpg_pairing, hard_gate_filter, duplicate_best, ratio_picks_38, burst_groups, cosine_pairs, person_components, similar_groups, linkage_levels, persona_strengths, persona_picks, override_latest_wins, people_overrides,
    multi_group_membership, facet_counts, display_neighbours, cache_misses, cache_eviction, transfer_manifest, rating_manifest, exposure_tiers, photo_findings,
    main_subjects, tone_histogram,
)}

_PAIRED = """p AS (SELECT '/lib/' || source AS dir, 'img_' || doc_id AS stem_key, CASE WHEN doc_id % 4 <> 0 THEN '/lib/' || source || '/IMG_' || doc_id || '.CR3' END AS raw_path,
 CASE WHEN doc_id % 3 <> 0 THEN '/lib/' || source || '/IMG_' || doc_id || '.jpg' END AS jpg_path FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 <> 0)"""
_LABELLED = "x AS (SELECT d.doc_id AS photo_id, source, lang, n_chars, md5(text) AS digest, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_COSINE = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {}"

_GROUPS = "WITH RECURSIVE e AS ({}), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, reached) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.reached = g.a) SELECT node, min(reached) AS component FROM r GROUP BY node"
_TRAITS = f"""{_LABELLED}, t AS (SELECT photo_id, source, n_chars, lang || ' ' || least(n_chars // 1000, 5) AS trait, coalesce(quality = 1 AND toxic = 0, false) AS kept, coalesce(toxic = 1 OR quality = 0, false) AS rejected FROM x),
c AS (SELECT source, trait, count(*) FILTER (kept) AS k, count(*) FILTER (rejected) AS r FROM t GROUP BY ALL),
w AS (SELECT a.trait AS i, b.trait AS j, sum(a.k * b.r) AS wins FROM c a JOIN c b ON a.source = b.source AND a.trait <> b.trait WHERE a.k > 0 AND b.r > 0 GROUP BY ALL),
n AS (SELECT i, j, sum(wins) AS wins, sum(n) AS n FROM (SELECT i, j, wins, wins AS n FROM w UNION ALL SELECT j, i, 0, wins FROM w) GROUP BY i, j),
p0 AS (SELECT i, sum(wins) AS won, 1::DOUBLE AS p FROM n GROUP BY i)""" + "".join(
    f", p{k + 1} AS (SELECT a.i, any_value(a.won) AS won, (any_value(a.won) + 1) / (sum(n.n / (a.p + b.p)) + 2 / (any_value(a.p) + 1)) AS p FROM n JOIN p{k} a ON a.i = n.i JOIN p{k} b ON b.i = n.j GROUP BY a.i)" for k in range(ROUNDS)
)
_TASTE = f"taste AS (SELECT i AS trait, round(p, 6) AS strength FROM p{ROUNDS})"

ORACLE_SQL = {
    "graded_colours": """WITH x AS (SELECT p_partkey, (p_partkey % 256) / 255::DOUBLE AS r, p_size / 60::DOUBLE AS g, (p_partkey % 101) / 100::DOUBLE AS b FROM part)
SELECT p_partkey, round(r * 0.6::DOUBLE + (1 - r) * 0.4::DOUBLE, 9) AS r, round(g * 0.6::DOUBLE + g / 2 * 0.4::DOUBLE, 9) AS g, round(b, 9) AS b FROM x""",
    "fused_scores": """WITH x AS (SELECT p_partkey, [CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 2000 END, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50::DOUBLE END, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 / 10::DOUBLE END, CASE WHEN p_partkey % 7 = 0 THEN 0.25::DOUBLE END, p_size % 4 / 4::DOUBLE] AS s,
 [0.6::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE] AS w FROM part), y AS (SELECT p_partkey, unnest(s) AS s, unnest(w) AS w FROM x)
SELECT p_partkey, round(sum(s * w) / sum(w), 9) AS score FROM y WHERE s IS NOT NULL GROUP BY p_partkey""",
    "grouped_review": f"""WITH {_LABELLED}, b AS (SELECT photo_id, row_number() OVER (PARTITION BY digest ORDER BY quality DESC NULLS LAST, photo_id) AS n FROM x WHERE coalesce(toxic, 0) = 0),
l AS (SELECT user_id * 3 AS photo_id, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject' ELSE 'unmarked' END AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
m AS (SELECT x.*, coalesce(l.mark, CASE WHEN b.n = 1 THEN 'keep' ELSE 'unmarked' END) AS mark FROM x LEFT JOIN b USING (photo_id) LEFT JOIN (SELECT * FROM l WHERE n = 1) l USING (photo_id))
SELECT source, mark, count(*) AS n, min(photo_id) AS first_id FROM m WHERE n_chars > 200 AND (mark = 'keep' OR lang = 'de') GROUP BY 1, 2""",
    "similar_groups": _GROUPS.format(_COSINE.format(PERSON_COSINE)),
    "linkage_levels": " UNION ALL ".join(f"SELECT {level}::DOUBLE AS cosine, component, count(*) AS n FROM ({_GROUPS.format(_COSINE.format(level))}) GROUP BY component" for level in LEVELS),
    "persona_strengths": f"WITH {_TRAITS}, {_TASTE} SELECT trait, strength FROM taste",
    "persona_picks": f"""WITH {_TRAITS}, {_TASTE}, y AS (SELECT photo_id, row_number() OVER (ORDER BY n_chars * 0.7::DOUBLE + round(coalesce(strength, 1) / (coalesce(strength, 1) + 1), 5) * 10000 * 0.3::DOUBLE DESC, photo_id) AS pick_rank, count(*) OVER () AS n
 FROM t LEFT JOIN taste USING (trait) WHERE NOT rejected) SELECT photo_id, pick_rank FROM y WHERE pick_rank <= (n * 38 + 99) // 100""",
    "raw_jpg_pairing": f"WITH {_PAIRED} SELECT dir, stem_key, raw_path, jpg_path FROM p",
    "hard_gate_filter": f"WITH {_LABELLED} SELECT source, count(*) AS n, min(photo_id) AS first_id FROM x WHERE toxic IS DISTINCT FROM 1 GROUP BY source",
    "duplicate_best": f"WITH {_LABELLED} SELECT photo_id, digest, quality::BIGINT AS quality FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY quality DESC NULLS LAST, photo_id) AS n FROM x WHERE coalesce(toxic, 0) = 0) WHERE n = 1",
    "ratio_picks_38": f"WITH {_LABELLED}, y AS (SELECT photo_id, row_number() OVER (ORDER BY n_chars * 0.7::DOUBLE + coalesce(quality * 1000.0::DOUBLE, n_chars::DOUBLE) * 0.3::DOUBLE DESC, photo_id) AS pick_rank, count(*) OVER () AS n FROM x WHERE coalesce(toxic, 0) = 0) SELECT photo_id, pick_rank FROM y WHERE pick_rank <= (n * 38 + 99) // 100",
    "burst_groups": f"WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {GAP_SECONDS * 1_000_000} THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst_no FROM g) SELECT user_id, burst_no, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM h GROUP BY 1, 2",
    "cosine_pairs": _COSINE.format(PAIR_COSINE),
    "person_components": f"WITH RECURSIVE e AS ({_COSINE.format(PERSON_COSINE)}), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, reached) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.reached = g.a) SELECT node, min(reached) AS component FROM r GROUP BY node",
    "override_latest_wins": "SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'signup' THEN 'reject' ELSE 'unmarked' END AS mark, CASE WHEN floor(value / 10) BETWEEN 1 AND 5 THEN floor(value / 10)::INT END AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "people_overrides": "SELECT CASE WHEN vec_id % 9 = 0 THEN 100 WHEN label = 3 THEN 1 ELSE label END AS person_id, count(*) AS faces, min(vec_id) AS first_face FROM embeddings GROUP BY 1",
    "multi_group_membership": "SELECT vec_id // 4 AS photo_id, count(DISTINCT label) AS groups FROM embeddings GROUP BY 1 HAVING bool_or(label IN (1, 2))",
    "facet_counts": f"WITH {_LABELLED} SELECT count(*) FILTER (toxic = 1) AS n_reject, count(*) FILTER (quality = 1 AND toxic = 0) AS n_keep, count(*) FILTER (quality IS NULL) AS n_unmarked, count(*) FILTER (quality = 0 AND toxic = 0) AS n_review, count(*) FILTER (n_chars > 2000) AS n_group, count(*) FILTER (lang = 'en' AND quality = 1) AS n_english_keep FROM x",
    "display_neighbours": f"WITH {_LABELLED} SELECT photo_id, lag(photo_id) OVER w AS previous_id, lead(photo_id) OVER w AS next_id FROM x WINDOW w AS (PARTITION BY source ORDER BY n_chars, photo_id)",
    "cache_misses": "SELECT event_type AS mode, count(*) AS misses, sum(user_id)::BIGINT AS user_sum FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING max(value) <= 50) GROUP BY 1",
    "cache_eviction": "SELECT event_type AS mode, count(*) AS evicted, max(event_id) AS newest_evicted FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 500 GROUP BY 1",
    "transfer_manifest": f"WITH {_PAIRED}, s AS (SELECT unnest([raw_path, jpg_path, replace(raw_path, '.CR3', '.xmp')]) AS source FROM p) SELECT source, '/out/' || regexp_extract(source, '[^/]*$') AS destination, 'move' AS action FROM s WHERE source IS NOT NULL",
    "rating_manifest": f"WITH {_PAIRED}, r AS (SELECT *, (length(stem_key) % 7)::INT AS rating FROM p WHERE length(stem_key) % 7 <= 5) SELECT replace(raw_path, '.CR3', '.xmp') AS target, 'xmp' AS form, rating FROM r WHERE raw_path IS NOT NULL UNION ALL SELECT jpg_path, 'metadata', rating FROM r WHERE jpg_path IS NOT NULL",
    "exposure_tiers": "SELECT CASE WHEN abs(c_acctbal / 4000) > 2.0 OR (c_custkey % 20) / 100 > 0.1 THEN 'heavy' WHEN abs(c_acctbal / 4000) > 1.0 THEN 'review' ELSE 'none' END AS tier, count(*) AS n FROM customer GROUP BY 1",
    "photo_findings": """WITH q AS (SELECT p_partkey AS photo_id, (p_size % 10) / 10 AS eye, (p_partkey % 13) / 12 AS focus, (p_partkey % 9) / 3 AS ev, (p_partkey % 17) / 100 AS clipped, p_type = 'ECONOMY' AS wide FROM part),
 f AS (SELECT photo_id, list_filter([CASE WHEN NOT wide AND eye < 0.2 THEN 'closed_eye:heavy' END, CASE WHEN focus < CASE WHEN wide THEN 0.35::DOUBLE * 0.8::DOUBLE ELSE 0.35 END THEN 'missed_focus:heavy' END,
 CASE WHEN ev > 2.0 OR clipped > 0.1 THEN 'exposure:heavy' WHEN ev > 1.0 THEN 'exposure:review' END, CASE WHEN clipped > 0.1 THEN 'lost_detail:review' END], lambda c: c IS NOT NULL) AS c FROM q)
 SELECT photo_id, coalesce(array_to_string(list_transform(c, lambda s: split_part(s, ':', 1)), ','), '') AS codes, coalesce(array_to_string(list_transform(c, lambda s: split_part(s, ':', 2)), ','), '') AS severities FROM f""",
    "main_subjects": "SELECT l_orderkey AS photo_id, l_linenumber AS face_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "tone_histogram": "SELECT year(l_shipdate)::INT AS key, least(9, greatest(0, floor(l_quantity / 5)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
}
