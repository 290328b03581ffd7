import hashlib
import re
import time

from pyspark.sql import functions as F

from quillspark.llm.pii import op8_pii, pii_spans, redact

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


ODD = [
    "a@b.c_x@d.e a@b a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.4567", "4111 1111 1111 1111 x 4111-1111-1111-1112 378282246310005 3782 822463 10005",
    "+1 (555) 123-4567 +49.30.1234567 +1 2 +12345678901234567 call +33 1 23 45 67 89.", "😀 é mail me😀: q.w@e.rt, x", "12--34 5 - 6", "+12 3.4.5.6 4111111111111111 a@1.2.3.4",
    "%+-@a.b @a.b x@@y.z x@y..z", "1" * 20_000, "1 " * 20_000, "+1 " + "(" * 20_000, "a." * 20_000 + "@", "00000000000000000255.0.0.1 9999999999999999999999.1.1.1",
]


def test_base_spans_equal_brute_force(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(make_docs(list(enumerate(ODD, 10_000))).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op8_pii(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
        own = [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert ",".join(own) == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in own) for k in ("email", "ip", "card", "phone")]


def test_added_kinds_need_checksums_or_context(make_docs):
    token = "0a1b2c3d4e5f60718293"
    texts = [
        "GB82WEST12345698765432 ok", "DE89 3704 0044 0532 0130 00.", "GB82WEST12345698765433", "SSN: 123-45-6789", "code 123-45-6789", "social security 000-45-6789",
        "123-45-6789 (ssn)", "born 1980-02-30, 31.12.1979", "born on 1980-13-01", "birth: none. " + "x " * 30 + "1980-01-02", f'Token = "{token}"', f"keys: {token}", "secret abcdefghijklmnopqrstuvwx",
    ]
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii_spans(make_docs(list(enumerate(texts))).select("doc_id", "text")).collect()}
    assert rows == {0: [("iban", 0, 22)], 1: [("iban", 0, 27)], 2: [], 3: [("ssn", 5, 16)], 4: [], 5: [], 6: [("ssn", 0, 11)], 7: [("birth", 5, 15)], 8: [], 9: [], 10: [("secret", 9, 29)], 11: [], 12: []}


def test_context_raises_the_score(make_docs):
    texts = {1: "call +33 1 23 45 67 89", 2: "it is +33 1 23 45 67 89", 3: "+33 1 23 45 67 89 (mobile)", 4: "mail a@b.c", 5: "a@b.c", 6: "server 1.2.3.4", 7: "v 1.2.3.4"}
    rows = op8_pii(make_docs(list(texts.items()))).collect()
    score = {r.doc_id: r.score for r in rows}
    assert score[1] == score[3] > score[2] and score[4] > score[5] and score[6] > score[7]


def test_redaction_covers_unions_of_spans(make_docs):
    docs = make_docs([(1, "é a@1.2.3.4 b +12 345 678 9012 c"), (2, "none"), (3, None), (4, "x@y.z"), (5, "😀1.2.3.4é1.2.3.4😀")]).select("doc_id", "text")
    got = {r.doc_id: r.text for r in redact(pii_spans(docs)).collect()}
    assert got == {1: "é <email> b <phone> c", 2: "none", 3: None, 4: "<email>", 5: "😀<ip>é<ip>😀"}


def test_time_is_linear_in_a_text_of_spans(make_docs):
    took = []
    for n in (1_000, 10_000, 20_000, 40_000):  # the first warms up
        docs = make_docs([(1, "é me@mail.de 10.0.0.1, " * n)]).select("doc_id", "text")
        began = time.time()
        row = redact(pii_spans(docs)).first()
        took.append(time.time() - began)
        assert row.text == "é <email> <ip>, " * n and len(row.spans) == 2 * n
    assert took[3] < 3 * took[2] + 1 and took[3] < 15, took


def test_odd_rows(odd_docs, make_docs):
    rows = op8_pii(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.spans for r in rows} == {""}
    assert op8_pii(make_docs([])).count() == 0
    assert "Python" not in op8_pii(odd_docs)._jdf.queryExecution().toString()
    assert pii_spans(odd_docs, out="found").where(F.size("found") > 0).count() == 0
