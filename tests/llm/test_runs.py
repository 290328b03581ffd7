import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.runs import Common, described, find_runs, op13_runs, periodic_runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(least, 2 * q) and smallest_period(words[i : k + q]) == q:
                out.append((i, k + q - i, q))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, runs and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def triples(runs):
    return list(zip(*(x.tolist() for x in runs)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 12))
def test_runs_equal_brute_force(words, least):
    assert triples(find_runs(np.array(words, dtype=np.int64), least)) == brute_runs(words, least)


def test_runs_of_repeated_stretches():
    rng = random.Random(5)
    for _ in range(60):
        words = []
        while len(words) < 150:
            piece = [rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randint(1, 15))]
            words += piece * rng.randint(1, 6)
        assert triples(find_runs(np.array(words))) == brute_runs(words), words


def test_common_prefixes():
    rng = random.Random(3)
    words = [rng.randrange(2) for _ in range(400)] + [0, 1, 1] * 60
    lce, pairs = Common(np.array(words)), [sorted(rng.sample(range(len(words)), 2)) for _ in range(2000)]
    i, j = np.array(pairs).T
    for a, b, got in zip(i, j, lce.prefix(i, j)):
        k = 0
        while b + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert got == k


def test_query_equals_brute_force(spark, sf_dir, make_docs):
    odd = [(7_000_000 + k, t) for k, t in enumerate([None, "", " \n\t ", "a " * 11, "a " * 12, "x y " * 6 + "x", "é b c " * 20, "one\x0btwo\x0cthree\r\n" * 5, "a b c d e f g h " * 2 + "a b c"])]
    planted = [(k, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + " ".join(f"u{i}" for i in range(k % 97))) for k in range(8_000_000, 8_000_300)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(make_docs([*odd, *planted]).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op13_runs(docs).collect()
    assert len(rows) == len(texts) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in texts) > 30
    for r in rows:
        assert tuple(r[1:]) == brute(r.doc_id, texts[r.doc_id]), r.doc_id


def test_time_is_near_linear_in_a_long_text():
    took = []
    for n in (1_000, 50_000, 200_000):
        for text in (b"same " * n, b" ".join(b"w%d" % (k * k % 9973) for k in range(n)), b" ".join(b"w%d" % (k % (n // 3)) for k in range(n))):
            began = time.time()
            found = described(text)
            took.append(time.time() - began)
            assert found[0] == 1 or n == 1_000
    assert max(took[6:]) < 8 * max(took[3:6]) + 1 and max(took) < 30, took


def test_odd_rows(odd_docs, make_docs):
    rows = op13_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len(rows[0]) == 8
    assert {tuple(r[1:]) for r in rows if r.doc_id == 1} == {brute(1, None)} and {tuple(r[1:]) for r in rows if r.doc_id is None} == {brute(None, "a null id")}
    assert len({tuple(r) for r in rows if r.doc_id == 5}) == 1
    assert op13_runs(make_docs([])).count() == 0
    plain = {r.doc_id: r for r in periodic_runs(odd_docs, least=8).collect()}
    assert (plain[6].n_runs, plain[6].start, plain[6].length, plain[6].period) == (1, 0, 100_000, 5)
