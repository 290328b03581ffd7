"""The pipeline against a brute-force version of its stages."""

import hashlib
import re

import corpus_pipeline
import pytest
from test_pii import brute as pii_brute
from test_simhash import plain_fingerprint
from tokenizers import Tokenizer

from quillspark.llm.bpe import default_tokenizer
from quillspark.llm.decontam import normalise
from quillspark.llm.toxicity import THRESHOLD, train


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if model.score(r.text) < THRESHOLD]
    kept = one_of_each_group(kept)
    items = [normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(s in normalise(t) for s in items)]

    def redacted(text):
        out, at = "", 0
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in pii_brute(text).split(",") if s)] + secrets(text)
        for a, b, kind in sorted(spans, key=lambda s: s[0]):
            if a >= at:
                out, at = out + text[at:a] + f"<{kind}>", b
            else:
                at = max(at, b)
        return out + text[at:]

    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {}
    for i, t in kept:
        ids = tokenizer.encode(redacted(t), add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(got) < docs.count()


def secrets(text):
    """Long tokens of letters and digits with a word for a secret within 40 characters; the gap ends at the next such token."""
    found, out = list(re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", text)), []
    word = re.compile("(?:^|[^a-z])(?:token|secret|password|passwd|api.?key|access.?key|bearer)")
    for k, m in enumerate(found):
        before = text[found[k - 1].end() if k else 0 : m.start()][-40:].lower()
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else None][:40].lower()
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and (word.search(before) or word.search(after)):
            out.append((m.start(), m.end(), "secret"))
    return out


def one_of_each_group(rows):
    """All pairs, linked by fingerprint or by exact sets of five-word shingles; the smallest id of each group."""
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    bits = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_stages_on_odd_rows(spark, odd_docs, make_docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for table in (odd_docs, make_docs([])):
        docs = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == table.columns
            docs = out
        assert docs.count() == (0 if table.isEmpty() else 5)


@pytest.mark.parametrize("text", ["write to a@b.cd now", None, ""])
def test_redaction_changes_the_length(spark, make_docs, text):
    row = corpus_pipeline.redact_personal_data(spark, make_docs([(1, text)]), "").first()
    assert row.n_chars == (None if text is None else len(row.text)) and not re.search("@", row.text or "")
