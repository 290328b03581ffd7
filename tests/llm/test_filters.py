import itertools
import re

import numpy as np
import pytest
from oracle import canonical, expected

from quillspark.llm.filters import Walk, adjacent_swaps, audit, mask_cells, op12_filters
from quillspark.llm.queries import ORACLE_SQL

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The letters each row ``(id, part, text)`` fails."""
    out = []
    for i, _, text in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        smaller = any(j is not None and i is not None and j < i and (u or "") == text for j, _, u in rows)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), smaller)
        out.append({letter for letter, failed in zip("ABCDE", tests) if failed})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed, out = fails(rows), []
    for part in {r[1] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[1] or "") == part]
        lines, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(here)
                lines.append(("".join(order), step, len(left), len(here), sum(letter in f for _, f in own) - len(here), sum(f == {letter} for _, f in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
        out += [(part, *x, shapley[x[0][x[1] - 1]]) for x in lines]
    return sorted(out)


def test_orders_differ_by_one_swap_of_neighbours():
    for n in range(1, 7):
        walked = list(adjacent_swaps(n))
        assert len({o for o, _ in walked}) == len(walked) == len(list(itertools.permutations(range(n))))
        for (before, _), (after, at) in zip(walked, walked[1:]):
            assert after == (*before[:at], before[at + 1], before[at], *before[at + 2 :])


def test_walk_equals_every_step_afresh():
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 50, (3, 6, 16))
    walk = Walk(4, *cells)
    orders, seen, shapley = walk.run()
    for order, steps in zip(orders, seen):
        for k, item in enumerate(order):
            assert (steps[k] == walk.step(sum(1 << i for i in order[:k]), item)).all()
    assert (shapley == sum(np.stack([steps[order.index(i)][1] for i in range(4)]) for order, steps in zip(orders, seen))).all()


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{k}" for k in range(60))
    texts = [long, long, long + " #", "a " * 60, "a " * 60, "A " * 60, None, "", "", "x", "A|B", long.upper(), long.upper(), long + " é"]
    return [(i, ("s", None, "t", "")[i % 4], t) for i, t in enumerate(texts)] + [(None, "s", long), (None, "n", "x"), (3, "s", "a " * 60), (3, "s", "a " * 60)]


def test_audit_equals_brute_force(spark, rows):
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (5, 1, None), (6, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, source string, text string, n int, mask string")
    got = op12_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == brute(rows, [x for x in labels if x[0] is not None])


def test_empty_tables(spark, rows):
    docs, none = spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame([], LABELS)
    assert op12_filters(docs.where("false"), none).count() == 0
    got = op12_filters(docs, none)
    assert sorted(map(tuple, got.collect())) == brute(rows, []) and got.columns[0] == "part"


def test_query_equals_sql(spark, sf_dir):
    df = op12_filters(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected(ORACLE_SQL["op12_filters"], sf_dir)


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "p", "a b"), (2, "p", "a b"), (3, "p", "c")], "doc_id long, source string, text string")
    cells = mask_cells(docs, spark.createDataFrame([], LABELS), {"X": "size(words) > 1"})
    assert sorted(map(tuple, cells.select("mask", "n").collect())) == [(0, 1), (1, 1), (3, 1)]
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in audit(cells, "XY").collect()} == {("XY", 1): (1, 2, 0), ("XY", 2): (1, 0, 1), ("YX", 1): (2, 1, 0), ("YX", 2): (1, 1, 1)}
