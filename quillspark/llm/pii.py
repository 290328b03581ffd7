"""Personal data spans from DataFrame functions only.

Regular expressions propose spans, validators (value ranges, digit counts, Luhn,
mod-97) confirm them, and words of the context on either side of a span raise its
score; kinds that are no base kind need a score, so some are reported only with such a
word. Positions are code points: a text's pieces between the matches, from ``split``
with the same pattern, give each match's start by prefix sums, so no span needs a
second search. The context reaches as far as the neighbouring match of the same kind.

Patterns are written so that a search is linear in the text: runs begin only at
their first character (or where the last match ended) and are possessive. That
changes no match, since each run is followed by a character outside its class.
Prefix sums take log n rounds over n matches, and redaction cuts bytes at known places.

Null texts count as empty. Texts without personal data give an empty array. Repeated
rows get equal spans; an empty table gives an empty result. Spans that begin together
are ordered by kind. Overlapping spans of different kinds are all reported; redaction covers their union.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
CONTEXT_CHARS = 40
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double,first_byte:int,end_byte:int>"
POWERS = "transform(sequence(0, 30), p -> shiftleft(1, p))"


class Kind(NamedTuple):
    name: str
    gate: str  # a cheap necessary condition, as a pattern
    pattern: str
    valid: str  # SQL over the matched text ``m``
    base: float
    context: str
    needs: float  # least score of a span that is reported


def _digits(m: str = "m") -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str = "m") -> str:
    digits = f"transform(sequence(1, length({_digits(m)})), i -> cast(substring({_digits(m)}, -i, 1) as int))"
    doubled = f"transform({digits}, (d, i) -> if(i % 2 = 1, d * 2 - if(d > 4, 9, 0), d))"
    return f"aggregate({doubled}, 0, (a, d) -> a + d) % 10 = 0"


def _mod97(m: str = "m") -> str:
    """Country code and check digits go last; letters count as 10 to 35, two decimal digits each."""
    bare = f"replace({m}, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    chars = f"transform(sequence(1, length({bare})), i -> ascii(substring({turned}, i, 1)))"
    return f"aggregate({chars}, 0, (a, c) -> if(c >= 65, (a * 100 + c - 55) % 97, (a * 10 + c - 48) % 97)) = 1"


KINDS = [
    Kind("email", "@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "true", 0.9, "mail|contact|write", 0.0),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"forall(split(m, '[.]'), p -> p rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')", 0.7, "ip|address|host|server", 0.0),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9])++",
         f"length({_digits()}) between 14 and 19 and {_luhn()}", 0.8, "card|visa|credit|payment", 0.0),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_digits()}) between 10 and 15", 0.7, "phone|call|tel|mobile", 0.0),
    Kind("iban", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
         f"length(replace(m, ' ', '')) between 15 and 34 and {_mod97()}", 0.8, "iban|account|bank", 0.5),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "not (m rlike '^(?:000|666|9)|-00-|-0000$')", 0.3, "ssn|social security", 0.5),
    Kind("birth", "(?i)born|birth|dob", "(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])",
         "m rlike '-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$|^(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|[12][0-9]|3[01])[./]'", 0.3, "born|birth|dob", 0.5),
    Kind("secret", "(?i)token|secret|passw|key|bearer", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])",
         "m rlike '[0-9]' and m rlike '[A-Za-z]'", 0.3, "token|secret|password|passwd|api.?key|access.?key|bearer", 0.5),
]
BASE_KINDS = ["email", "ip", "card", "phone"]


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\'") + "'"


def _running(array: str, step: str) -> str:
    """SQL for the running ``step(x, y)`` of an array, by doubling: log n rounds that each touch every element once."""
    combined = step.format(x="x", y="acc[i - k]")
    return f"aggregate({POWERS}, {array}, (acc, k) -> if(k < size(acc), transform(acc, (x, i) -> if(i >= k, {combined}, x)), acc))"


def _bound(names: dict[str, str], body: str) -> str:
    """SQL for ``body`` over ``b.<name>``, each name's expression evaluated once."""
    fields = ", ".join(f"{sql} as {name}" for name, sql in names.items())
    return f"transform(array(struct({fields})), b -> {body})[0]"


def _found(text: str, kind: Kind, rank: int) -> str:
    """SQL for the array of confirmed spans of one kind."""
    pattern = _sql(kind.pattern)
    near = f"struct(m, b.gaps[i] as gap, lower(right(b.gaps[i], {CONTEXT_CHARS})) as before, lower(left(b.gaps[i + 1], {CONTEXT_CHARS})) as after)"
    matches = _bound({"found": f"regexp_extract_all({text}, {pattern}, 0)", "gaps": f"split({text}, {pattern}, -1)"}, f"transform(b.found, (m, i) -> {near})")
    ends = [_running(f"transform(b.all, x -> {size}(x.gap) + {size}(x.m))", "{x} + {y}") for size in ("length", "octet_length")]
    both = f"zip_with({ends[0]}, {ends[1]}, (end, end_byte) -> struct(end, end_byte))"
    placed = _bound({"all": matches}, f"zip_with(b.all, {both}, (x, e) -> struct(x, e.end as end, e.end_byte as end_byte))")
    word = f"rlike '(?:^|[^a-z])(?:{kind.context})'"
    score = f"least(1.0d, {kind.base}d + if(s.x.before {word} or s.x.after {word}, 0.2d, 0.0d))"
    fields = f"s.end - length(s.x.m) as start, {rank} as rank, s.end as end, '{kind.name}' as kind, {score} as score, s.end_byte - octet_length(s.x.m) as first_byte, s.end_byte as end_byte"
    spans = f"transform(filter({placed}, s -> exists(array(s.x.m), m -> {kind.valid})), s -> struct({fields}))"
    return f"if({text} rlike {_sql(kind.gate)}, filter({spans}, s -> s.score >= {kind.needs}), cast(array() as array<{SPAN}>))"


def pii_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", kinds: list[Kind] | None = None) -> DataFrame:
    """``docs`` with a column of spans, by start and then kind: start and end in code points and bytes, kind and score."""
    text = f"coalesce(`{text_col}`, '')"
    parts = ", ".join(_found(text, k, n) for n, k in enumerate(kinds or KINDS))
    return docs.withColumn(out, F.expr(f"array_sort(concat({parts}))"))


def redact(docs: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span by its kind in angle brackets; of overlapping spans, the first names the whole union."""
    text, all_ = f"`{text_col}`", f"`{spans}`"
    reached = _running(f"transform({all_}, s -> s.end_byte)", "greatest({x}, {y})")
    # A span that begins where no earlier one reaches opens a union; ``done`` is the byte up to which the text is settled.
    opened = f"filter(transform({all_}, (s, i) -> struct(s.first_byte as first, s.kind as kind, if(i = 0, 0, b.reached[i - 1]) as done)), h -> h.first >= h.done)"
    piece = "concat(cast(substring(b.raw, h.done + 1, h.first - h.done) as string), '<', h.kind, '>')"
    tail = f"cast(substring(b.raw, b.reached[size({all_}) - 1] + 1) as string)"
    done = _bound({"raw": f"cast({text} as binary)", "reached": reached}, f"concat(array_join(transform({opened}, h -> {piece}), ''), {tail})")
    return docs.withColumn(text_col, F.expr(f"if(size({all_}) > 0, {done}, {text})"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def op8_pii(docs: DataFrame) -> DataFrame:
    names = ", ".join(f"'{k}'" for k in BASE_KINDS)
    found = pii_spans(docs.select("doc_id", "text"), out="found").withColumn("base", F.expr(f"filter(found, s -> s.kind in ({names}))"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"), F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("score"))
