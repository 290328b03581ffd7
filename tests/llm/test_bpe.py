import hashlib

import pytest
from tokenizers import Tokenizer

from quillspark.llm.bpe import bpe_decode, bpe_digest, bpe_encode, decode_ids, default_tokenizer, encode_texts, op7_bpe, vocabulary

ODD = [
    "", "   ", "a", "aaaaaaa aaaa", "ΑΣ ΟΔΟΣ Σ", "İstanbul Ǆ ǅ", "it's we'll I'D don'T 's's", "<|endoftext|>x<|startoftext|> <|EndOfText|> <| |>", "e\u0301 é \x1c\x1d a\x1fb !\x1c!",
    "日本語 テキスト 123 ½ ²", "😀😀 👩\u200d👩\u200d👧", "\ufeff x\u200by\u2003z", "a\x85b\x0bc", "ﬁ ẞ ß", "-----!!!!==== ...", "\x00\x01", "ŉ ǰ Å Å", "x" * 5000, "<|endoftext|>" * 3,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_and_decoding_equal_the_library(reference, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    vocab = vocabulary(default_tokenizer())
    for text, got, want in zip(texts, encode_texts(vocab, texts), reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, text[:80]
        assert decode_ids(vocab, got.tolist()) == reference.decode(want.ids, skip_special_tokens=False)


def test_merges_only_feed_later_merges():
    """The order of application rests on this: no merge makes a pair of a smaller rank possible."""
    vocab = vocabulary(default_tokenizer())
    made = {}
    for rank, (a, b, m) in enumerate(zip(vocab.left.tolist(), vocab.right.tolist(), vocab.made.tolist())):
        assert made.get(a, -1) < rank and made.get(b, -1) < rank
        made[m] = rank


def test_query_digests(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op7_bpe(docs).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tables_of_ids_and_odd_rows(odd_docs, make_docs, reference):
    encoded = bpe_encode(odd_docs, default_tokenizer(), chunk_bytes=64)
    rows = {r.doc_id: r.ids for r in encoded.collect()}
    assert rows[1] == rows[2] == rows[3] == [] and rows[4] == reference.encode("same text here", add_special_tokens=False).ids
    decoded = {r.doc_id: r.text for r in bpe_decode(encoded, default_tokenizer()).collect()}
    assert decoded[1] == "" and decoded[5] == reference.decode(rows[5], skip_special_tokens=False)
    assert bpe_digest(odd_docs, default_tokenizer()).count() == odd_docs.count()
    assert bpe_encode(make_docs([]), default_tokenizer()).count() == 0 and op7_bpe(make_docs([])).count() == 0
