import random

import numpy as np
import pytest

from quillspark.llm.decontam import PieceIndex, benchmark_hits, drop_contaminated, myers_search, normalise, op9_decontam


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best, end = row[-1], 0
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(150):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (90, 160))
        assert myers_search(p, t) == sellers(p, t)


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(k, "#"), lambda: chars.insert(k, "#"), lambda: chars.pop(k)])()
    return "".join(chars)


def test_every_passage_within_budget_is_found():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    items = [(k, words(rng.randint(10, 60))) for k in range(20)]
    index = PieceIndex(items)
    budgets = {k: b for k, _, b in index.items}
    for k, item in items:
        s = normalise(item)
        for edits in (0, 1, budgets[k]):
            text = words(30) + " " + edited(s, edits, rng) + " " + words(30)
            hits = {h[0]: h for h in index.match(text.upper().replace(" ", " \n "))}
            want = sellers(s, normalise(text.replace("#", "#")))[0]
            assert k in hits and hits[k][1] == want <= edits
    assert index.match(words(3000)) == []


def plain_distances(items, text):
    """Least distance of each item to any substring of the text: a plain dynamic program, all items at once."""
    most = max(map(len, items))
    chars = np.zeros((len(items), most), np.int32)
    for k, s in enumerate(items):
        chars[k, : len(s)] = [ord(c) for c in s]
    down = np.arange(most + 1, dtype=np.int16)
    row = np.tile(down, (len(items), 1))
    ends, every = np.array([len(s) for s in items]), np.arange(len(items))
    best = row[every, ends].copy()
    new = np.empty_like(row)
    for c in text:
        new[:, 0] = 0
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (chars != ord(c)), out=new[:, 1:])
        new -= down
        np.minimum.accumulate(new, axis=1, out=new)
        new += down
        row, new = new, row
        np.minimum(best, row[every, ends], out=best)
    return best


def test_query_equals_a_plain_scan_of_the_table(spark, sf_dir, make_docs):
    """All items and whole texts, with edits too: some items are planted with as many as fit, some with one more."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rng, items = random.Random(6), [(r.item_id, normalise(r.text)) for r in bench.collect()]
    planted = [(10_000 + 2 * k + more, f"so it is {edited(s, len(s) // 20 + more, rng)} and on") for k, (_, s) in enumerate(items) for more in (0, 1)]
    docs = docs.select("doc_id", "text").unionByName(make_docs(planted).select("doc_id", "text"))
    got = {(r.doc_id, r.item_id): r.distance for r in op9_decontam(docs, bench).collect()}
    assert max(got.values()) > 2
    want = {}
    for d in docs.collect():
        if text := normalise(d.text):
            for (i, s), n in zip(items, plain_distances([s for _, s in items], text).tolist()):
                if n <= len(s) // 20:
                    want[d.doc_id, i] = n
    assert got == want


@pytest.mark.parametrize("length", [19, 20, 39, 40, 41, 60])
def test_the_budget_follows_one_rule_at_every_length(length):
    item = ("what stands at the end of the longest river in the country")[:length].rstrip().ljust(length, "x")
    index, most = PieceIndex([(1, item)]), length // 20
    for edits in range(most + 2):
        changed = list(item)
        for k in range(edits):
            changed[(2 * k + 1) * length // (2 * edits)] = "#"
        assert [h[1] for h in index.match(f"so {''.join(changed)} it is")] == [edits] * (edits <= most)


def test_edges_of_items_are_edges_of_words():
    items = [(1, "What is the capital of Peru? Lima"), (2, "art"), (3, "(b)"), (4, "one two"), (5, " \n ")]
    found = lambda text, **how: {i for i, _, _ in PieceIndex(items, **how).match(text)}
    assert found("So: what is  the capital of PERU? Lima, of course") == {1} and found("So: what is  the capitol of PERU? Lima, of course") == {1}
    assert found("parts of a start") == set() and found("art, party") == {2} and found("state of the art") == {2}
    assert found("a(b)c") == {3} and found("someone two") == set() and found("one\ttwo") == {4}
    assert found("parts", whole_words=False) == {2} and found("xwhat is the capital of peru? limax", whole_words=False) == {1}
    assert PieceIndex(items).match("party art art")[0] == (2, 0, 9)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_odd_rows_and_blocks(spark, odd_docs, make_docs, block_bytes):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short"), (5, "it"), (None, item + " again and again")], "item_id long, text string")
    docs = odd_docs.unionByName(make_docs([(50, f"so {item.upper()}  it said"), (50, item), (None, item)]))
    hits = benchmark_hits(docs, bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(50, 1), (None, 1), (50, 5)} and len(hits) == 7
    clean = drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == odd_docs.count()
    assert benchmark_hits(make_docs([]), bench).count() == 0
    assert benchmark_hits(docs, bench.where("false")).count() == 0 and drop_contaminated(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(9,2)", "double"])
def test_ids_of_any_type(spark, kind):
    make = "date'2024-01-05'" if kind == "date" else f"cast(7 as {kind})"
    docs, bench = (spark.sql(f"select {make} as {name}, 'nothing but a short item' as text") for name in ("doc_id", "item_id"))
    row = op9_decontam(docs, bench).first()
    assert row.doc_id == row.item_id and row.distance == 0
