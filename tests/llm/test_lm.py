import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.lm import DISCOUNT, EliasFano, Frequent, NgramTrie, Packed, build_trie, language_scores, nodes_of, op10_lm, pack_chunk, parts_of, quantise, score_shard, word_hashes


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [0, 1, 2, 3], [0, 1 << 40, (1 << 62) + 7], "random", "dense"])
def test_elias_fano(values):
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 45, 5000)) if values == "random" else np.sort(rng.integers(0, 900, 5000)) if values == "dense" else np.array(values)
    values = values.astype(np.uint64)
    packed, end = EliasFano.view(np.frombuffer(EliasFano.pack(values) + b"rest", np.uint8), 0)
    assert end == len(EliasFano.pack(values)) and (packed[np.arange(len(values))] == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, int(values[-1]) + 9, 500).astype(np.uint64), [np.uint64(0)]])
    assert (packed.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((packed.find(asked) >= 0) == np.isin(asked, values)).all()
    first = rng.integers(0, len(values) + 1, len(asked))
    end = np.minimum(len(values), first + rng.integers(0, 9, len(asked)))
    want = [a + int(np.searchsorted(values[a:b], x)) for x, a, b in zip(asked, first, end)]
    assert packed.successor(asked, first, end).tolist() == want
    assert EliasFano.view(np.frombuffer(EliasFano.pack(values[:0]), np.uint8), 0)[0].find(asked).max() == -1


def test_levels_stay_packed():
    values = np.sort(np.random.default_rng(3).integers(0, 1 << 34, 200_000)).astype(np.uint64)
    data = EliasFano.pack(values)
    level, _ = EliasFano.view(np.frombuffer(data, np.uint8), 0)
    assert len(data) < 2.8 * len(values) and level.nbytes < 1.15 * len(data)
    assert sum(x.nbytes for x in vars(level).values() if isinstance(x, np.ndarray) and x is not level.low) == level.nbytes


def test_the_search_stays_inside_the_range_of_the_pointers():
    """The same word after two contexts: with the pointers of the other context it is not found."""
    contexts, owner, words = np.array([3, 9], dtype=np.uint64), np.array([0, 0, 1, 1]), np.array([1, 8, 1, 8], dtype=np.uint64)
    trie = NgramTrie.mapped(NgramTrie.pack(contexts, owner, words, np.array([-1.0, -2, -3, -4]), np.array([-0.1, -0.2])))
    ask = lambda: trie.look_up(np.array([3, 3, 9, 9], dtype=np.uint64), np.array([1, 8, 1, 8], dtype=np.uint64))[0]
    assert np.allclose(ask(), [-1, -2, -3, -4])
    trie.pointers, _ = EliasFano.view(np.frombuffer(EliasFano.pack(np.array([0, 1, 3])), np.uint8), 0)
    assert np.allclose(ask(), [-1, np.nan, -3, np.nan], equal_nan=True)


def test_trie_from_a_mapped_file(tmp_path):
    contexts = np.array([3, 9, 40], dtype=np.uint64)
    owner, words = np.array([0, 0, 1, 2]), np.array([1, 8, 8, 2], dtype=np.uint64)
    (tmp_path / "t").write_bytes(NgramTrie.pack(contexts, owner, words, np.array([-1.0, -2, -3, -4]), np.array([-0.1, -0.2, -0.3])))
    trie = NgramTrie.open(str(tmp_path / "t"))
    prob, back = trie.look_up(np.array([3, 3, 9, 9, 40, 7], dtype=np.uint64), np.array([1, 8, 8, 1, 2, 1], dtype=np.uint64))
    assert np.allclose(prob, [-1, -2, -3, np.nan, -4, np.nan], equal_nan=True) and np.allclose(back, [-0.1, -0.1, -0.2, -0.2, -0.3, 0])
    values = np.random.default_rng(0).normal(size=5000)
    codes, table = quantise(values)
    assert np.abs(table[codes] - values).mean() < 0.006 and np.abs(table[codes] - values).max() < 0.1


def counted(corpus, held):
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in corpus.items()}
    uni = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    pairs = Counter(p for i, ws in words.items() if not held[i] for p in zip([b"\n"] + ws, ws))
    return words, uni, pairs


def plain_scores(corpus):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in corpus}
    words, uni, pairs = counted(corpus, held)
    n, v = sum(uni.values()), len(uni)
    kinds = Counter(a for a, _ in pairs)
    common = {w for w in uni if uni[w] > n / 2000}
    left_out = Counter()
    for a, b in pairs:
        if b in common:
            left_out[a] += (uni[b] + 1) / (n + v + 1)
    out = {}
    for i, ws in words.items():
        model = 0.0
        for a, b in zip([b"\n"] + ws, ws):
            model += math.log10((pairs[a, b] - DISCOUNT) / uni[a]) if (a, b) in pairs else math.log10((uni[b] + 1) / (n + v + 1)) + (math.log10(DISCOUNT * kinds[a] / uni[a] / (1 - left_out[a])) if kinds[a] else 0)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        out[i] = (held[i], len(ws), n, sum(uni[w] > 0 for w in ws), base, model)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_scores({r.doc_id: r.text for r in docs.collect()})
    rows = op10_lm(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n_tokens, n, known, base, model = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held, n_tokens, n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(model - r.score) < 0.02 * n_tokens + 0.05
    assert abs(sum(r.score - want[r.doc_id][5] for r in rows)) < 0.002 * sum(r.n_tokens for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_a_hot_context_is_split_as_far_as_its_count_needs(spark):
    """A third of all pairs have one context: no shard holds much more than its aim, and scores stay what they are."""
    rng = np.random.default_rng(5)
    corpus = {i: " ".join(w for k in rng.integers(0, 3000, 100) for w in ("the", f"w{k}", f"v{k % 50}")) for i in range(80)}
    words, uni, pairs = counted(corpus, dict.fromkeys(corpus, False))
    tokens, aim = sum(uni.values()), 500
    shards = -(-tokens // aim)
    frequent = Frequent(word_hashes([b"the"]), np.array([float(uni[b"the"])]), tokens, len(uni), np.zeros(256), shards)
    assert frequent.parts.tolist() == [1 << math.ceil(math.log2(2 * uni[b"the"] / (tokens / shards)))] and parts_of(np.array([1e11]), 2e6)[0] == 1 << 17
    c, w = (word_hashes([p[k] for p in pairs]) for k in (0, 1))
    load = np.bincount(frequent.shard_of(c, w), list(pairs.values()), shards)
    assert load.max() < 4 * aim and Counter(a for a, _ in pairs.elements())[b"the"] > 7 * load.max()
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    want = plain_scores(corpus)
    for r in language_scores(docs, tokens_per_shard=aim).collect():
        assert (r.n_tokens, r.n_known) == (want[r.doc_id][1], want[r.doc_id][3]) and math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        # A part backs off to the words of its class, so unseen pairs differ a little from those of an unsplit context.
        assert abs(r.score - want[r.doc_id][5]) < (0.12 if r.held_out else 0.02) * r.n_tokens


def frequent_of(lines, shards, parts):
    uni = Counter(int(h) for line in lines for h in word_hashes(line[1:]))
    n, v = sum(uni.values()), len(uni)
    masses = np.zeros(256)
    for h, c in uni.items():
        masses[h % 256] += (c + 1) / (n + v + 1)
    hot = {h: c for h, c in uni.items() if c > n / 8}
    f = Frequent(np.array(list(hot), dtype=np.uint64), np.array(list(hot.values()), dtype=float), n, v, masses, shards)
    f.parts[:] = parts
    return f, uni


@pytest.mark.parametrize("parts", [1, 4])
def test_shards_split_contexts_and_pieces_agree(parts):
    """Sums over shards do not depend on how contexts are split or rows cut into pieces; probabilities sum to at most 1."""
    rng = np.random.default_rng(2)
    vocab = [b"w%d" % k for k in range(40)]
    lines = [[b"\n", *rng.choice(vocab, 60, p=np.arange(40, 0, -1) / 820).tolist(), b"\n"] for _ in range(30)]
    frequent, uni = frequent_of(lines, 5, parts)
    number = {w: k for k, w in enumerate({w: 0 for line in lines for w in line})}
    hashes = word_hashes(list(number))
    coded = [np.array([number[w] for w in line]) for line in lines]
    held = [False] * len(lines)
    pieces = [{row: x[a : a + 18]} for row, x in enumerate(coded) for a in range(0, len(x) - 1, 17)]
    results = []
    for chunks in ([dict(enumerate(coded))], pieces):
        by_shard = {}
        for chunk in chunks:
            for s, data in pack_chunk(0, held, chunk, hashes, frequent):
                by_shard.setdefault(s, []).append(Packed(data))
        sums = [score_shard(p, frequent, DISCOUNT)[0] for p in by_shard.values()]
        results.append({k: sum(np.pad(s[k], (0, 0)).reshape(-1, len(lines)).sum(axis=0) for s in sums) for k in ("known", "base", "model")})
    for k in ("known", "base", "model"):
        assert np.allclose(results[0][k], results[1][k], atol=1e-9)
    assert results[0]["known"].tolist() == [60] * len(lines)
    want = [sum(math.log10(uni[int(h)] + 1) for h in word_hashes(line[1:-1])) for line in lines]
    assert np.allclose(results[0]["base"], want)

    pairs = Counter((int(a), int(b)) for line in lines for a, b in zip(word_hashes(line), word_hashes(line)[1:]))
    ctx, word = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    spread, part = frequent.split(ctx, word)
    hashes, nodes = nodes_of(ctx, spread, part)
    order = np.lexsort((word, nodes))
    buffer, own, _ = build_trie(nodes[order], hashes, word[order], np.array(list(pairs.values()))[order], frequent, DISCOUNT)
    trie, floor = NgramTrie(np.frombuffer(buffer, np.uint8)), frequent.tokens + frequent.distinct + 1
    total = Counter()
    words = np.array(list(uni), dtype=np.uint64)
    for c in np.unique(ctx):
        spread, part = frequent.split(np.full(len(words), c), words)
        asked = np.uint64(np.searchsorted(hashes, c) << 21) | np.where(spread > 1, part + 1, 0).astype(np.uint64)
        prob, back = trie.look_up(asked, words)
        unigram = np.array([(uni[int(w)] + 1) / floor for w in words])
        known = np.isin(asked, own)
        p = np.where(np.isnan(prob), 10**back * unigram, 10**prob)
        assert p[known].sum() <= 1.03  # one-byte codes
        total["nodes"] += 1
    assert total["nodes"] > 20


def test_each_of_many_parts_backs_off_to_its_own_class():
    parts, rng = 512, np.random.default_rng(8)
    words = np.unique(rng.integers(0, 1 << 56, 6_000).astype(np.uint64))
    counts = rng.integers(1, 9, len(words))
    n, v = int(counts.sum()), len(words)
    masses = np.bincount((words % np.uint64(parts)).astype(int), (counts + 1) / (n + v + 1), parts)
    frequent = Frequent(np.array([77], dtype=np.uint64), np.array([float(n)]), n, v, masses, 8)
    frequent.parts[:] = parts
    seen = words[::2]
    spread, part = frequent.split(np.full(len(seen), 77, dtype=np.uint64), seen)
    hashes, nodes = nodes_of(np.full(len(seen), 77, dtype=np.uint64), spread, part)
    order = np.lexsort((seen, nodes))
    buffer, own, totals = build_trie(nodes[order], hashes, seen[order], np.ones(len(seen)), frequent, DISCOUNT)
    kinds = np.bincount(part, minlength=parts)
    want = np.log10(DISCOUNT * kinds[kinds > 0] / n / masses[kinds > 0])
    assert len(own) == (kinds > 0).sum() > 500 and (totals == n).all()
    _, back = NgramTrie(np.frombuffer(buffer, np.uint8)).look_up(own, np.full(len(own), words[1]))
    assert np.abs(back - want).max() < 0.03


def test_sparse_sequences_of_large_values():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5).astype(np.uint64))
    for some in (values, values[-2:], values[-1:]):
        packed = EliasFano.view(np.frombuffer(EliasFano.pack(some), np.uint8), 0)[0]
        assert packed[np.arange(len(some))].tolist() == some.tolist() and packed.find(some).tolist() == list(range(len(some)))


def test_odd_rows(odd_docs, make_docs):
    rows = language_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[6].n_tokens == 100_001
    assert by[None].held_out is False and sum(r.doc_id == 5 for r in rows) == 2
    assert op10_lm(make_docs([])).count() == 0
    only_held = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = op10_lm(make_docs([(only_held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
