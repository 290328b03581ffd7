"""Chats as training text, from DataFrame functions only: typed content parts, a template, a loss mask, and the way back.

A turn's content is an array of parts of ``PART``: text, image, audio or document. A
visitor flattens them in order: texts as they are, every other part as a placeholder
such as ``<image/>``, whose reference and token count go to the conversation's
``attachments``; the k-th placeholder belongs to the k-th attachment. A turn becomes
``<turn role>``, line feed, content, line feed, ``</turn>``, line feed; the role is URL-encoded.

Control strings inside texts are escaped by a backslash after their ``<``, and one that
is already written so gets one more; so a marker is never text, also where texts of
neighbouring parts would form it together, and undoing removes one backslash. The mask
names the stretches of the formatted text that a model learns from: the texts of turns of
``loss_role``, without placeholders.

Null texts, parts and roles count as empty; a null conversation id is a conversation.
Parts of an unknown or null kind count as text; sizes that are null or not positive count
as the least. Turns with the same number are ordered by role and content, so repeated
rows stay turns; null numbers come first. An empty table gives an empty result. A
conversation is one row of the result, so its text must fit one row (2 GB); its turns meet in one
task, sorted and with all lengths summed by one window, in linear time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.pii import _bound, _running

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PLACEHOLDER = "<(?:image|audio|document)/>"
#: What follows ``<`` in a control string.
CONTROL = "turn |/turn>|image/>|audio/>|document/>"
TAIL = "\n</turn>\n"


class Expansion(NamedTuple):
    """Tokens that an attachment becomes: a grid of image patches, a rate of audio, a size of a page; one at least."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 800


def text_parts(turns: DataFrame, text_col: str = "text", out: str = "parts") -> DataFrame:
    """``turns`` with their plain text as a content of one part."""
    nothing = ", ".join(f"cast(null as {kind}) as {name}" for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))
    return turns.withColumn(out, F.expr(f"array(struct('text' as kind, cast(`{text_col}` as string) as text, {nothing}))"))


def _escaped(joined: str) -> str:
    """SQL: texts in ``joined`` have a comma after each ``<`` and placeholders none; so only texts are escaped."""
    return rf"replace(regexp_replace({joined}, r'<,(\\*+)({CONTROL})', r'<\\$1$2'), '<,', '<')"


def unescaped(text: str) -> str:
    """SQL for the text that was escaped."""
    return rf"regexp_replace({text}, r'<\\(\\*+)({CONTROL})', r'<$1$2')"


def visited(turns: DataFrame, parts_col: str = "parts", expansion: Expansion = Expansion()) -> DataFrame:
    """``turns`` with ``body``, the flattened and escaped content, and ``attached``, what its placeholders stand for."""
    grid = f"ceil(greatest(coalesce(p.width, 1), 1) / {expansion.patch}) * ceil(greatest(coalesce(p.height, 1), 1) / {expansion.patch})"
    tokens = (
        f"cast(case p.kind when 'image' then {grid} when 'audio' then greatest(1, ceil(greatest(coalesce(p.seconds, 0d), 0d) * {expansion.per_second}d)) "
        f"else greatest(coalesce(p.pages, 1), 1) * {expansion.per_page} end as bigint)"
    )
    other = "p.kind in ('image', 'audio', 'document')"
    joined = f"array_join(transform({parts_col}, p -> if({other}, concat('<', p.kind, '/>'), replace(coalesce(p.text, ''), '<', '<,'))), '')"
    attached = f"transform(filter({parts_col}, p -> {other}), p -> struct(p.kind as kind, p.ref as ref, p.text as text, {tokens} as tokens))"
    return turns.withColumns({"body": F.expr(_escaped(joined)), "attached": F.expr(attached)})


def _text_spans() -> str:
    """SQL for the stretches of ``body`` that are text, in code points and bytes from its beginning."""
    # A marker is ASCII, so its length is the same in code points and bytes.
    pieces = _bound({"texts": f"split(body, '{PLACEHOLDER}', -1)", "marks": f"regexp_extract_all(body, '{PLACEHOLDER}', 0)"},
                    "transform(b.texts, (x, i) -> struct(length(x) as chars, octet_length(x) as bytes, coalesce(length(get(b.marks, i)), 0) as mark))")
    ends = [_running(f"transform(b.all, x -> cast(x.{size} + x.mark as bigint))", "{x} + {y}") for size in ("chars", "bytes")]
    spans = "zip_with(b.all, b.ends, (x, e) -> struct(e.chars - x.mark - x.chars as start, e.chars - x.mark as end, e.bytes - x.mark - x.bytes as first_byte, e.bytes - x.mark as end_byte))"
    both = f"zip_with({ends[0]}, {ends[1]}, (chars, bytes) -> struct(chars, bytes))"
    placed = _bound({"all": pieces}, f"struct(b.all as all, {both} as ends)")
    return f"filter({_bound({'all': f'{placed}.all', 'ends': f'{placed}.ends'}, spans)}, s -> s.end > s.start)"


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant",
    expansion: Expansion = Expansion(),
) -> DataFrame:
    """``(conv_col, n_turns, formatted, mask, attachments, attached_tokens)``, one row per conversation."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(parts_col), F.expr(f"cast(array() as array<{PART}>)")).alias("parts"),
    )
    rows = visited(rows, expansion=expansion).withColumn("head", F.expr(r"concat('<turn ', url_encode(role), '>\n')"))
    rows = rows.select("conv", "turn", "role", "head", "body", "attached")
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = {n: F.expr(f"cast({f}(head) as bigint) + {f}(body) + {len(TAIL)}") for n, f in (("chars", "length"), ("bytes", "octet_length"))}
    placed = rows.withColumns({
        "nth": F.row_number().over(order), **{n: F.coalesce(F.sum(s).over(before), F.lit(0)) for n, s in size.items()},
        "inside": F.when(F.col("role") == loss_role, F.expr(_text_spans())).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,first_byte:bigint,end_byte:bigint>>)")),
    })
    shift = ", ".join(f"s.{f} + {n} + {length}(head) as {f}" for f, n, length in (("start", "chars", "length"), ("end", "chars", "length"), ("first_byte", "bytes", "octet_length"), ("end_byte", "bytes", "octet_length")))
    attachment = "transform(attached, a -> struct(nth as turn, a.kind as kind, a.ref as ref, a.text as text, a.tokens as tokens))"
    made = placed.select("conv", F.struct(
        "nth", F.concat("head", "body", F.lit(TAIL)).alias("block"), F.expr(f"transform(inside, s -> struct({shift}))").alias("mask"), F.expr(attachment).alias("attachments"),
    ).alias("made"))
    grouped = made.groupBy("conv").agg(F.array_sort(F.collect_list("made")).alias("made"))
    tokens = "aggregate(attachments, 0L, (n, a) -> n + a.tokens)"
    return grouped.select(
        F.col("conv").alias(conv_col), F.size("made").cast("bigint").alias("n_turns"), F.array_join("made.block", "").alias("formatted"),
        F.flatten("made.mask").alias("mask"), F.flatten("made.attachments").alias("attachments"),
    ).withColumn("attached_tokens", F.expr(tokens))


def read_chats(chats: DataFrame, text_col: str = "formatted", out: str = "turns") -> DataFrame:
    """``chats`` with the turns parsed from their text: role, texts around the placeholders, unescaped, and placeholders' kinds."""
    piece = f"filter(split(`{text_col}`, '\n</turn>\n', -1), (x, i) -> x <> '')"
    head = r"regexp_extract(x, '^<turn [^>]*>\n', 0)"
    bodies = f"transform({piece}, x -> struct(url_decode(regexp_extract(x, '^<turn ([^>]*)>', 1)) as role, substring(x, length({head}) + 1) as body))"
    texts = f"transform(split(t.body, '{PLACEHOLDER}', -1), x -> {unescaped('x')})"
    kinds = "regexp_extract_all(t.body, '<(image|audio|document)/>', 1)"
    return chats.withColumn(out, F.expr(f"transform({bodies}, t -> struct(t.role as role, {texts} as texts, {kinds} as kinds))"))


def loss_text(chats: DataFrame, out: str = "loss_text", text_col: str = "formatted", mask_col: str = "mask") -> DataFrame:
    """``chats`` with all text under the mask, cut from the formatted text and unescaped."""
    cut = "cast(substring(b.raw, cast(m.first_byte + 1 as int), cast(m.end_byte - m.first_byte as int)) as string)"
    return chats.withColumn(out, F.expr(_bound({"raw": f"cast(`{text_col}` as binary)"}, f"array_join(transform(`{mask_col}`, m -> {unescaped(cut)}), '')")))


SAMPLE = r"\### Assistant: </turn> ok"


def op11_chat(conversations: DataFrame) -> DataFrame:
    """All conversations and number -7, whose two turns hold control strings; every column is read back from the formatted text."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = loss_text(read_chats(format_chats(text_parts(turns))))
    said = r"array_join(transform(turns, t -> concat(t.role, '\n', array_join(t.texts, ''), '\n')), '')"
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.expr(said), 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP11_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAMPLE}' UNION ALL SELECT -7, 1, 'assistant', '{SAMPLE}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(text, '<(\\*)({CONTROL})', '<\\\1\2', 'g')) + 17)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
