import random
import re
import time

import pytest

from quillspark.llm.licenses import PHRASES, TEMPLATES, LicenceIndex, SuffixAutomaton, licence_scan, op2_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        text = [rng.randint(1, 4) for _ in range(30)]
        auto = SuffixAutomaton(seqs)
        subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for end, (state, size) in enumerate(auto.stream(text), 1):
            assert size == max((n for n in range(end + 1) if tuple(text[end - n : end]) in subs), default=0) if size else all(tuple(text[end - n : end]) not in subs for n in range(1, end + 1))
            if size:
                found = tuple(text[end - size : end])
                places = {(k, b) for k, s in enumerate(seqs) for b in range(size, len(s) + 1) if tuple(s[b - size : b]) == found}
                assert places == set(auto.ends[state])


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), sorted((k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p)


def test_query_equals_brute_force(spark, sf_dir, make_docs):
    texts = ["MIT License mit license. The GENERAL public license apache-license général mit  license", "general public public license general public license mit license license", "a mit", "MIT", "license"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(make_docs(list(enumerate(texts, 10_000))).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op2_licenses(docs).collect():
        n, places = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_covered_also_with_changes():
    index = LicenceIndex(TEMPLATES, PHRASES)
    for label, text in TEMPLATES:
        for changed in (text, f"so it goes {text.upper()} and on", text.replace(" of ", " of the new ") if len(text) > 200 else text):
            spans = index.scan(index.tokens(changed.encode()))[1]
            assert label in {s.label for s in spans}, changed
    cut = TEMPLATES[2][1]
    assert not index.scan(index.tokens(cut[: len(cut) // 3].encode()))[1]


def plain_chains(index, ids):
    """Labels and best scores by the definition: longest matches by comparison, chains by all pairs of places."""
    seqs, n = index.sequences, len(ids)
    subs = [{} for _ in range(max(map(len, seqs)) + 1)]
    for k, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                subs[b - a].setdefault(tuple(s[a:b]), []).append((k, b))
    longest = [0]
    for end in range(1, n + 1):
        longest.append(next((m for m in range(min(end, len(subs) - 1), 0, -1) if tuple(ids[end - m : end]) in subs[m]), 0))
    ends = [e for e in range(1, n + 1) if longest[e] >= index.min_match and (e == n or longest[e + 1] <= longest[e])]
    places = [(k, e, b, longest[e]) for e in ends for k, b in subs[longest[e]][tuple(ids[e - longest[e] : e])] if k >= index.phrases]
    covered = []
    for i, (k, e, b, size) in enumerate(places):
        best = size
        for j in range(i):
            k2, e2, b2, _ = places[j]
            overlap = max(0, e2 - (e - size), b2 - (b - size))
            if k2 == k and e2 <= e and b2 <= b and overlap < size and e - size - e2 <= index.max_gap and b - size - b2 <= index.max_gap:
                best = max(best, covered[j] + size - overlap)
        covered.append(best)
    shares = [(index.labels[k], min(1.0, c / len(seqs[k]))) for (k, *_), c in zip(places, covered) if c >= index.min_cover * len(seqs[k])]
    return {label for label, _ in shares}, max((x for _, x in shares), default=0.0)


def test_chains_equal_brute_force_on_edited_templates():
    index, rng, found = LicenceIndex(TEMPLATES, PHRASES), random.Random(8), 0
    pool = [w for _, t in TEMPLATES for w in t.split()]
    for _ in range(150):
        words = []
        for label, text in rng.sample(TEMPLATES, 2):
            part = text.split()
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(part) + 1)
                kind = rng.randrange(4)
                if kind == 0:
                    part[at:at] = rng.choices(pool, k=rng.randint(1, 4))  # stray words of templates
                elif kind == 1:
                    a = rng.randrange(len(pool))
                    part[at:at] = pool[a : a + rng.randint(4, 9)]  # a stray fragment
                elif kind == 2:
                    del part[at : at + rng.randint(1, 3)]
                else:
                    part[at : at + 1] = ["changed"]
            words += [*part, *["other"] * rng.randint(0, 12)]
        ids = index.tokens(" ".join(words).encode())
        spans = index.scan(ids)[1]
        labels, score = plain_chains(index, ids.tolist())
        assert ({s.label for s in spans}, max((s.score for s in spans), default=0.0)) == (labels, score), words
        found += len(spans)
    assert found > 100


def test_a_stray_fragment_does_not_part_a_chain():
    index, text = LicenceIndex(TEMPLATES, PHRASES), TEMPLATES[2][1].split()
    for stray in ("of this software and", "one two three four"):
        words = [*text[:10], *stray.split(), *text[10:46], "changed", *text[47:]]
        best = max(index.scan(index.tokens(" ".join(words).encode()))[1], key=lambda s: s.score)
        assert best.label == "mit" and best.score > 0.9


def test_time_is_linear_in_a_text_of_licence_lines():
    index = LicenceIndex(TEMPLATES, PHRASES)
    took = []
    for n in (5_000, 10_000, 20_000):
        ids = index.tokens(b"Released under the MIT License. " * n)
        began = time.process_time()
        places, spans = index.scan(ids)
        took.append(time.process_time() - began)
        assert len(places) == n and len(spans) == n
    assert took[2] < 3 * took[1] + 0.2 and took[1] < 3 * took[0] + 0.2


def test_phrases_of_one_word():
    index = LicenceIndex(TEMPLATES, {"gpl": "gpl", "mit license": "mit", "license": "any"})
    assert sorted(index.scan(index.tokens(b"GPL. the mit license, gpl"))[0]) == [(0, 0), (0, 4), (1, 2), (2, 3)]
    assert index.scan(index.tokens(b"gpl"))[0] == [(0, 0)]
    with pytest.raises(ValueError):
        LicenceIndex(TEMPLATES, {"--": "none"})


def test_odd_rows(odd_docs, make_docs):
    rows = {r.doc_id: r for r in op2_licenses(odd_docs).collect()}
    assert rows[1].n_words == rows[2].n_words == 0 and rows[6].n_words == 100_000 and rows[7].n_words == 1
    assert all((r.labels, r.score, r.first_word) == ("", 0.0, None) for r in rows.values())
    assert licence_scan(make_docs([])).count() == 0 and op2_licenses(make_docs([])).count() == 0
