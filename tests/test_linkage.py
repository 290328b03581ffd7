"""Links from bands, spanning forests, bounded groups, and the persona's strengths."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators.durable import durable
from quillspark.operators.library import duplicates, linkage, persona
from quillspark.operators.library.duplicates import Bands, banded_links, similarity_groups

VECTORS = "vec_id long, embedding array<double>"


def clustered(n, groups, spread, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))


def table(spark, m):
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(m)], VECTORS)


def exact_pairs(m, threshold):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j): c[i, j] for i, j in zip(*np.nonzero(np.triu(c >= threshold, 1)))}


@pytest.mark.parametrize("threshold, spread", [(0.35, 1.0), (0.6, 0.6), (0.9, 0.25)])
def test_banded_links_find_nearly_all_pairs(spark, threshold, spread):
    m = clustered(600, 40, spread)
    want = exact_pairs(m, threshold)
    got = {(r.a, r.b): r.cosine for r in banded_links(table(spark, m), threshold, spanning=False).collect()}
    assert len(want) > 500 and set(got) <= set(want) and len(got) > 0.9 * len(want)
    assert all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in got.items())


def test_visits_are_bounded_and_cells_shrink_with_the_threshold():
    for n in (1_000, 10**6, 10**9):
        for threshold in (0.35, 0.5, 0.7, 0.9, 0.99):
            plan = Bands.planned(n, threshold)
            same = (1 - math.acos(threshold) / math.pi) ** plan.bits
            assert 1 <= plan.bands <= 64 and 1 - (1 - same) ** plan.bands >= 0.95
    assert Bands.planned(10**6, 0.35).bits >= 6 and Bands.planned(10**6, 0.9).bits >= 16
    assert Bands.planned(1000, 0.5, recall=0.999, most_visits=1) == Bands(1, 0)  # one cell: all rows meet


def test_copies_meet_as_one_and_links_stay_few(spark):
    """A third of all rows are copies of one vector: no task sees them all, no pairs of them come out."""
    m = np.concatenate([np.tile(np.arange(1.0, 9.0), (500, 1)), clustered(1000, 30, 0.3, dims=8)])
    links = banded_links(table(spark, m), 0.9).collect()
    copied = [(r.a, r.b) for r in links if r.b < 500]
    assert sorted(copied) == [(0, k) for k in range(1, 500)] and len(links) < 60 * len(m)
    got = {r.node: r.component for r in similarity_groups(banded_links(table(spark, m), 0.9)).collect()}
    assert {got[k] for k in range(500)} == {0}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_pairs_at_a_low_threshold_come_from_blocks(spark, monkeypatch, kind):
    """No vector visits a cell where it would visit nearly all of them, and copies hang on their smallest id."""
    monkeypatch.setattr(duplicates, "LEAST_BLOCK", 50)
    m = clustered(400, 40, 1.0).astype(np.float32)
    rows = table(spark, np.concatenate([m, m[:3]])).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    want = exact_pairs(m.astype(float), 0.35)
    assert duplicates._blocks(400, 8)[0] == 8 and duplicates._blocks(600_000, 64)[0] < 40
    got = [(r.a, r.b) for r in duplicates.representative_pairs(rows, 0.35).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want) | {(0, 400), (1, 401), (2, 402)}
    banded = {(r.a, r.b) for r in banded_links(rows, 0.4, recall=0.9999, most_visits=160, spanning=False).collect()}
    assert banded == {k for k, c in want.items() if c >= 0.4} | {(0, 400), (1, 401), (2, 402)}


def test_a_row_repeats_itself_in_pieces():
    """What a batch of rows visits leaves in pieces, so memory does not grow with rows and cells together."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[1.0, float(k)] for k in range(1000)])], names=["id", "v"])
    parts = list(duplicates._slices(batch))
    assert max(p.num_rows for p in parts) <= duplicates.SLICE and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))
    assert np.array_equal(np.concatenate([duplicates._matrix(p.column(1)) for p in parts])[:, 1], np.arange(1000.0))
    with pytest.raises(ValueError, match="unequal"):
        duplicates._matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_vectors_without_a_direction(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0])]
    assert {(r.a, r.b) for r in banded_links(spark.createDataFrame(rows, VECTORS), 0.9).collect()} == {(3, 5), (3, 4)}
    assert banded_links(spark.createDataFrame([], VECTORS), 0.9).count() == 0


def kruskal(edges):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted(edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((w, a, b))
    return out


def random_links(seed, nodes=60, edges=150):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([1.0, 2.0, rng.random() * 3])) for _ in range(edges)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_equals_a_plain_one(spark, seed):
    links = random_links(seed)
    least = {}
    for a, b, w in links:
        if a != b:
            least[min(a, b), max(a, b)] = min(w, least.get((min(a, b), max(a, b)), 9))
    want = kruskal([(w, *k) for k, w in least.items()])
    got = linkage.spanning_forest(spark.createDataFrame([*links, (None, 1, 0.1), (1, 2, None)], "a long, b long, w double"))
    assert sorted((r.w, r.a, r.b) for r in got.collect()) == sorted(want)  # equal weights are ordered by their ends
    for most in (0.5, 1.0, 2.5):
        linked = kruskal([e for e in want if e[0] <= most])
        groups = linkage.level_groups(got, most)
        nodes = {n for _, a, b in want for n in (a, b)}
        assert groups.select("component").distinct().count() == len(nodes) - len(linked) and groups.count() == len(nodes)


def test_depths_of_trees(spark):
    links = [(0, 1, 1.0), (1, 2, 2.0), (1, 3, 0.5), (3, 4, 0.25), (10, 11, 7.0), *[(20, k, 1.5) for k in range(21, 40)]]
    got = {r.node: (r.parent, r.depth) for r in linkage.depths(durable(spark.createDataFrame(links, "a long, b long, w double"))).collect()}
    assert got == {1: (0, 1.0), 2: (1, 3.0), 3: (1, 1.5), 4: (3, 1.75), 11: (10, 7.0)} | {k: (20, 1.5) for k in range(21, 40)}


def test_bounded_groups_do_not_fuse_chains(spark):
    """Points on half a circle: one group by single linkage, groups of bounded diameter here."""
    m = np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, math.pi, 80)] + [[-math.cos(t), -math.sin(t)] for t in np.linspace(1.0, 1.1, 10)])
    links = [(int(i), int(j), float(c)) for (i, j), c in exact_pairs(m, math.cos(0.1)).items()]
    table_ = linkage.angles(spark.createDataFrame(links, "a long, b long, cosine double"))
    whole = linkage.level_groups(linkage.spanning_forest(table_), 0.1)
    assert whole.select("component").distinct().count() == 2
    diameter = 0.6
    groups = {}
    for r in linkage.bounded_groups(table_, diameter).collect():
        groups.setdefault(r.component, []).append(r.node)
    assert sorted(itertools.chain(*groups.values())) == list(range(90)) and all(min(v) == k for k, v in groups.items())
    angle = lambda i, j: math.acos(max(-1, min(1, float(m[i] @ m[j]))))
    assert max(angle(i, j) for v in groups.values() for i in v for j in v) <= diameter
    assert 7 <= len(groups) <= 14  # half a circle and a short arc


def test_empty_links(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert linkage.spanning_forest(none).count() == 0 and linkage.bounded_groups(none, 1.0).count() == 0


def plain_strengths(photos, rounds):
    wins = {}
    for g, t, k, _ in photos:
        for h, u, _, r in photos:
            if g == h and t != u and k and r and None not in (g, t, u):
                wins[t, u] = wins.get((t, u), 0) + 1
    p = {t: 1.0 for pair in wins for t in pair}
    for _ in range(rounds):
        p = {
            t: (sum(w for (a, _), w in wins.items() if a == t) + 1)
            / (sum((wins.get((t, u), 0) + wins.get((u, t), 0)) / (p[t] + p[u]) for u in p if u != t) + 2 / (p[t] + 1))
            for t in p
        }
    return p


def test_strengths_equal_plain_ones_and_settle(spark):
    rng = random.Random(4)
    taste = {"a": 0.9, "b": 0.6, "c": 0.5, "d": 0.1}
    photos = [(rng.randrange(12), t, k, not k) for t in rng.choices("abcd", k=200) for k in [rng.random() < taste[t]]] + [(None, "a", True, False), (1, None, False, True)]
    found = durable(persona.contests(spark.createDataFrame(photos, "g int, t string, k boolean, r boolean"), "g", "t", F.col("k"), F.col("r")))
    for rounds in (1, 5):
        got = {r.trait: r.strength for r in persona.strengths(found, rounds=rounds, tolerance=0.0).collect()}
        want = plain_strengths(photos, rounds)
        assert set(got) == set(want) and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)
    steps = [plain_strengths(photos, n) for n in range(12)]
    settled = next(n for n in range(1, 12) if max(abs(math.log(steps[n][t] / steps[n - 1][t])) for t in steps[n]) <= 0.2)
    got = {r.trait: r.strength for r in persona.strengths(found, tolerance=0.2).collect()}
    assert 1 < settled < 11 and all(math.isclose(got[t], steps[settled][t], rel_tol=1e-9) for t in got) and got["a"] > got["b"] > got["d"]
    scored = persona.scored(spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "id int, t string"), spark.createDataFrame([("a", 3.0)], "trait string, strength double"), "t")
    assert {r.id: r.persona for r in scored.collect()} == {1: 0.75, 2: 0.5, 3: 0.5}
    assert persona.strengths(found.where("false")).count() == 0
