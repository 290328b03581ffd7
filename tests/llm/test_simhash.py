import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.simhash import BKForest, _jobs, fingerprint, fingerprint_links, fingerprints, keep_one, linked_codes, near_duplicates, op3_simhash, similarity_links, sketch
from quillspark.operators.durable import durable


def plain_fingerprint(text):
    words = (text or "").translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)}))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(root(k), []).append(ids[k])
    return [min((x for x in groups[root(k)] if x is not None), default=None) for k in range(len(fps))]


def test_fingerprints_follow_the_definition():
    rng = np.random.default_rng(3)
    texts = ["", " \n", "One", "one two THREE", "a b c d", "A B\tc d\ne", "É é Ü x y", " ".join(rng.choice(list("abcdef"), 900)), " ".join(rng.choice(["uno", "dos", "tres"], 50)), "a\xa0b c\x1cd e f g"]
    assert [fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def clusters(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    return np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, n, dtype=np.uint64)) for _ in range(12)]]))


def test_tree_edges_are_distances_and_searches_follow_only_near_ones():
    rng = np.random.default_rng(4)
    codes = np.concatenate([clusters(rng, 20), clusters(rng, 9)])
    shard = np.repeat([3, 8], [len(codes) - len(clusters(np.random.default_rng(0), 9)), len(clusters(np.random.default_rng(0), 9))])
    tree = BKForest(codes, shard)
    assert len(tree.slots) + 2 == len(codes) and len(np.unique(tree.slots)) == len(tree.slots)  # one child per edge
    parent, edge = tree.slots // 65, tree.slots % 65
    assert (np.bitwise_count(codes[parent] ^ codes[tree.kids]) == edge).all() and (shard[parent] == shard[tree.kids]).all()
    # every node hangs in the subtree whose edge is its distance to each ancestor
    up = dict(zip(tree.kids.tolist(), zip(parent.tolist(), edge.tolist())))
    for k in range(len(codes)):
        node = k
        while node in up:
            node, e = up[node]
            assert (int(codes[node]) ^ int(codes[k])).bit_count() == e
    asked = codes[:60] ^ np.uint64(5)
    found = {(int(q), int(n)) for qs, ns in tree.search(asked, np.full(60, tree.roots[0]), 4) for q, n in zip(qs, ns)}
    assert found == {(q, n) for q in range(60) for n in np.flatnonzero(shard == 3).tolist() if (int(asked[q]) ^ int(codes[n])).bit_count() <= 4}


def test_tree_links_equal_brute_force(monkeypatch):
    monkeypatch.setattr("quillspark.llm.simhash.VISITS", 3000)
    rng = np.random.default_rng(5)
    codes = clusters(rng, 40)
    label = linked_codes(codes, np.zeros(len(codes), np.int64), np.full(len(codes), -1), 4)
    want = brute([int(c) for c in codes], list(range(len(codes))), 4)
    assert label.tolist() == want
    side = rng.integers(0, 2, len(codes))
    label = linked_codes(codes, np.zeros(len(codes), np.int64), side, 4)
    for k, low in enumerate(label.tolist()):
        assert low == k or any(side[j] != side[k] and (int(codes[j]) ^ int(codes[k])).bit_count() <= 4 for j in range(len(codes)))


def test_links_survive_crowded_shards(spark):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**62))
    codes = sorted({centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**62, 100)})
    links = fingerprint_links(spark.createDataFrame([(c,) for c in codes], "fp long"), 4, shard_cap=16).collect()
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for u, v in links:
        assert (u ^ v).bit_count() <= 64
        parent[root(u)] = root(v)
    want = brute(codes, list(range(len(codes))), 4)
    for i in range(len(codes)):
        for j in range(i):
            assert (root(codes[i]) == root(codes[j])) == (want[i] == want[j])


def test_query_equals_brute_force_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op3_simhash(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in got)
    assert [r.component_id for r in got] == brute([int(r.fingerprint, 16) for r in got], [r.doc_id for r in got], 4)


def test_odd_rows(odd_docs, make_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[5].component_id == 4 and by[None].component_id is None
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, None], key=str)
    assert keep_one(make_docs([(1, "x"), (1, "x")])).count() == 1
    assert near_duplicates(make_docs([])).count() == 0 and keep_one(make_docs([])).count() == 0


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def varied(words, changes, rng):
    words = list(words)
    for k in rng.choice(len(words), changes, replace=False):
        words[k] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 5000, 600)]
    errors = []
    for changes in (0, 5, 10, 15, 30, 60):
        a, b = " ".join(base), varied(base, changes, rng)
        x, y = (np.frombuffer(sketch(t.encode())[1], np.uint8) for t in (a, b))
        errors.append(((x == y).mean() * 256 - 1) / 255 - jaccard(a, b))
    assert np.abs(errors).max() < 0.13
    assert sketch(b"")[0] == [] and len(sketch(b"one")[0]) == 6


def test_similar_texts_are_linked_and_others_are_not(make_docs):
    rng = np.random.default_rng(13)
    bases = [[f"w{k}" for k in rng.integers(0, 5000, int(n))] for n in rng.integers(200, 600, 25)]
    texts, group = [], []
    for g, base in enumerate(bases):
        texts.append(" ".join(base))
        group.append(g)
        for _ in range(3):  # each change touches five shingles
            texts.append(varied(base, len(base) // 100, rng))
            group.append(g)
    assert min(jaccard(texts[k], texts[k - k % 4]) for k in range(len(texts))) > 0.88
    rows = {r.doc_id: r.component_id for r in near_duplicates(make_docs(list(enumerate(texts))), similarity=0.8).collect()}
    assert [rows[k] for k in range(len(texts))] == [4 * g for g in group]
    kept = keep_one(make_docs(list(enumerate(texts))), similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == [4 * g for g in range(len(bases))]


def test_links_follow_exact_similarity(make_docs):
    rng = np.random.default_rng(17)
    texts = []
    for n in rng.integers(20, 900, 60):  # pairs around the bar, short ones too
        base = [f"w{k}" for k in rng.integers(0, 5000, int(n))]
        texts += [" ".join(base), varied(base, max(1, round(n * rng.uniform(0.01, 0.045))), rng)]
    near = [jaccard(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert sum(0.7 < x < 0.8 for x in near) > 5 and sum(0.8 <= x < 0.9 for x in near) > 5
    bits = [fingerprint(t.encode()) for t in texts]
    rows = {r.doc_id: r.component_id for r in near_duplicates(make_docs(list(enumerate(texts))), similarity=0.8).collect()}
    for k, x in enumerate(near):
        apart = (bits[2 * k] ^ bits[2 * k + 1]).bit_count()
        assert rows[2 * k] == 2 * k and (rows[2 * k + 1] == 2 * k) == (x >= 0.8 or apart <= 4)


def test_groups_on_the_table_follow_exact_similarity(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in docs]
    bits = [fingerprint(t.encode()) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = {r.doc_id: r.component_id for r in near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=0.8).collect()}
    assert [rows[i] for i, _ in docs] == [docs[k][0] for k in root]


def test_crowded_similarity_shards_lose_no_pair(make_docs):
    rng = np.random.default_rng(19)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    texts = [varied(base, int(n), rng) for n in rng.integers(1, 6, 60)]
    docs = make_docs(list(enumerate(texts)))
    marked = durable(fingerprints(docs, sketched=5))
    entries = marked.select(F.explode("keys").alias("key"), "whole", "fp", "n", "sketch")
    alike = lambda links: connected_groups([(r.u, r.v) for r in links.collect()])
    assert alike(similarity_links(docs, marked, 0.8, block=8, set_block=4)) == alike(similarity_links(docs, marked, 0.8))
    jobs = _jobs(entries, 8, "whole")
    assert entries.groupBy("key").count().agg(F.max("count")).first()[0] > 40
    assert jobs.groupBy("job").count().agg(F.max("count")).first()[0] < 40
    pairs = jobs.alias("a").join(jobs.alias("b"), F.expr("a.job = b.job and a.whole < b.whole and (a.side < 0 or a.side <> b.side)"))
    want = entries.alias("a").join(entries.alias("b"), F.expr("a.key = b.key and a.whole < b.whole"))
    pick = ["a.key", "a.whole", F.col("b.whole").alias("other")]
    assert sorted(pairs.select(*pick).collect()) == sorted(want.select(*pick).collect())  # each pair once
    # With labels, pairs of one label need not meet; every other pair meets once.
    grouped = entries.withColumn("label", F.when(F.pmod("whole", F.lit(3)) > 0, 0).otherwise(F.col("whole")).cast("long"))
    jobs = _jobs(grouped, 8, "whole")
    pairs = jobs.alias("a").join(jobs.alias("b"), F.expr("a.job = b.job and a.whole < b.whole and a.label <> b.label and (a.side < 0 or a.side <> b.side)"))
    want = grouped.alias("a").join(grouped.alias("b"), F.expr("a.key = b.key and a.whole < b.whole and a.label <> b.label"))
    assert sorted(pairs.select(*pick).collect()) == sorted(want.select(*pick).collect())
    alone = _jobs(entries.withColumn("label", F.lit(1).cast("long")), 8, "whole")
    big = entries.groupBy("key").count().where("count > 8").select("key")
    assert alone.join(big, "key").count() == 0  # nothing left to compare


def test_only_crowded_shards_are_dealt_into_blocks(make_docs, monkeypatch):
    """Entries of small shards pass no join with the list of crowded ones; links stay the same."""
    rng = np.random.default_rng(31)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    alone = [[f"w{k}" for k in rng.integers(0, 5000, 150)] for _ in range(40)]
    texts = [varied(base, int(n), rng) for n in rng.integers(1, 6, 30)] + [varied(words, n, rng) for words in alone for n in (0, 2)]
    docs = make_docs(list(enumerate(texts)))
    marked = durable(fingerprints(docs, sketched=5))
    want = connected_groups([(r.u, r.v) for r in similarity_links(docs, marked, 0.8).collect()])
    dealt = []
    monkeypatch.setattr(simhash, "_jobs", lambda entries, block, by: dealt.append((entries, block)) or _jobs(entries, block, by))
    monkeypatch.setattr(simhash, "release", lambda table: None)  # what was dealt is counted afterwards
    assert connected_groups([(r.u, r.v) for r in similarity_links(docs, marked, 0.8, block=8, set_block=4).collect()]) == want
    entries = next(e for e, block in dealt if block == 8)
    sizes = [r["count"] for r in entries.groupBy("key").count().collect()]
    assert sizes and min(sizes) > 8 and sum(sizes) < 6 * len(texts) / 2


def test_one_id_with_unrelated_texts_keeps_both(make_docs):
    words = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(3)]
    docs = make_docs([(1, words[0]), (1, words[1]), (2, words[1]), (2, words[2]), (2, words[2]), (3, words[0])])
    kept = sorted((r.doc_id, words.index(r.text)) for r in keep_one(docs, similarity=0.8).collect())
    assert kept == [(1, 0), (1, 1), (2, 2)]


def test_recall_of_pairs_at_the_bar(make_docs):
    """Pairs just above 0.8, alone and inside one crowded shard: at least nine in ten are linked, and here all."""
    rng = np.random.default_rng(29)
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        base = [*shared, *[f"w{k}" for k in rng.integers(0, 50_000, 240)]]
        texts += [" ".join(base), " ".join([*base[:60], *varied(base[60:], 6, rng).split()])]
    near = [jaccard(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert min(near) >= 0.8 and max(near) < 0.9
    docs = make_docs(list(enumerate(texts)))
    links = similarity_links(docs, durable(fingerprints(docs, sketched=5)), 0.8, block=16, set_block=8)
    groups = connected_groups([(r.u, r.v) for r in links.collect()])
    bits = [int(np.array(fingerprint(t.encode()), np.uint64).view(np.int64)) for t in texts]
    met = [groups.get(a, a) == groups.get(b, b) for a, b in zip(bits[::2], bits[1::2])]
    assert sum(met) >= 0.9 * len(met) and len(set(groups.values())) == sum(met)


def connected_groups(links):
    root = {x: x for link in links for x in link}
    for u, v in links:
        a, b = sorted((root[u], root[v]))
        root = {x: a if r == b else r for x, r in root.items()}
    return root


def test_a_repeated_passage_does_not_part_similar_texts(make_docs):
    rng = np.random.default_rng(23)
    texts = []
    for k in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        texts += [" ".join(base), " ".join(base + base[100:120] * 30)]
    assert min(jaccard(a, b) for a, b in zip(texts[::2], texts[1::2])) > 0.9
    bits = [fingerprint(t.encode()) for t in texts]
    assert any((a ^ b).bit_count() > 20 for a, b in zip(bits[::2], bits[1::2]))
    rows = {r.doc_id: r.component_id for r in near_duplicates(make_docs(list(enumerate(texts))), similarity=0.8).collect()}
    assert [rows[k] for k in range(len(texts))] == [k - k % 2 for k in range(len(texts))]
