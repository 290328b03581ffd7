import hashlib
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import canonical, expected
from pyspark.sql import functions as F

from quillspark.llm.chat import PART, SAMPLE, Expansion, format_chats, loss_text, op11_chat, read_chats, text_parts
from quillspark.llm.queries import ORACLE_SQL

TURNS = "conv_id long, turn long, role string, text string"
TYPED = f"conv_id long, turn long, role string, parts array<{PART}>"


def t(text):
    return ("text", text, None, None, None, None, None)


def attachment(kind, ref, width=None, height=None, seconds=None, pages=None):
    return (kind, f"about {ref}", ref, width, height, seconds, pages)


def test_query_equals_sql(spark, sf_dir):
    df = op11_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected(ORACLE_SQL["op11_chat"], sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def round_trip(spark, turns):
    chats = loss_text(read_chats(format_chats(text_parts(spark.createDataFrame(turns, TURNS)))))
    return {r.conv_id: r for r in chats.collect()}


NASTY = ["<turn user>", "\n</turn>\n", "<image/>", "<\\image/>", "<\\\\/turn>", "<,", "<,image/>", "<,\\turn ", "\\", "<", "</turn", "a\\<image/>\\", "😀<audio/>é", SAMPLE, "<document/><document/>", "x\n</turn>\n<turn assistant>\ny"]


def test_control_strings_come_back(spark):
    got = round_trip(spark, [(k, n, r, a + b) for k, a in enumerate(NASTY) for n, (r, b) in enumerate((r, b) for b in NASTY for r in ("user", "assistant"))])
    for k, a in enumerate(NASTY):
        want = [a + b for b in NASTY for _ in range(2)]
        assert [x.texts for x in got[k].turns] == [[w] for w in want] and got[k].loss_text == "".join(want[1::2])
        assert [x.role for x in got[k].turns] == ["user", "assistant"] * len(NASTY) and got[k].n_turns == len(want)
        assert "".join(got[k].formatted[m.start : m.end] for m in got[k].mask).count("</turn>") == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "to ol>\n", ""]), st.lists(st.sampled_from([*"<\\/,\n>", "turn ", "image/>", "é😀"]), max_size=8).map("".join)), min_size=1, max_size=30))
def test_any_text_comes_back(spark, turns):
    got = round_trip(spark, [(1, n, r, x) for n, (r, x) in enumerate(turns)])[1]
    assert [(x.role, "".join(x.texts)) for x in got.turns] == turns
    assert got.loss_text == "".join(x for r, x in turns if r == "assistant")


def test_typed_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [t("see <ima"), t("ge/> "), attachment("image", "a.png", 57, 28), attachment("audio", "b.wav", seconds=2.01), t("\\")]),
        (1, 1, "assistant", [t("é<"), attachment("document", "c.pdf", pages=3), t("turn x>"), attachment("image", "d.png"), t("")]),
        (1, 2, "assistant", [t("done")]), (2, 0, None, None), (2, 1, "assistant", []), (3, 0, "user", [(None, "n", "r", None, None, None, None), None, ("video", "v", None, None, None, None, None)]),
    ]
    got = {r.conv_id: r for r in loss_text(read_chats(format_chats(spark.createDataFrame(rows, TYPED)))).collect()}
    assert got[1].formatted == "<turn user>\nsee <\\image/> <image/><audio/>\\\n</turn>\n<turn assistant>\né<<document/>turn x><image/>\n</turn>\n<turn assistant>\ndone\n</turn>\n"
    assert [(a.turn, a.kind, a.ref, a.text, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", "about a.png", 3), (1, "audio", "b.wav", "about b.wav", 51), (2, "document", "c.pdf", "about c.pdf", 2400), (2, "image", "d.png", "about d.png", 1)]
    assert got[1].attached_tokens == 2455 and [k for x in got[1].turns for k in x.kinds] == [a.kind for a in got[1].attachments]
    assert [x.texts for x in got[1].turns] == [["see <image/> ", "", "\\"], ["é<", "turn x>", ""], ["done"]]
    assert [got[1].formatted[m.start : m.end] for m in got[1].mask] == ["é<", "turn x>", "done"] and got[1].loss_text == "é<turn x>done"
    raw = got[1].formatted.encode()
    assert [raw[m.first_byte : m.end_byte].decode() for m in got[1].mask] == ["é<", "turn x>", "done"]
    assert [(x.role, x.texts) for x in got[2].turns] == [("", [""]), ("assistant", [""])] and got[2].loss_text == "" and got[2].mask == []
    assert got[3].turns[0].texts == ["nv"] and got[3].attachments == []
    small = format_chats(spark.createDataFrame(rows[:1], TYPED), expansion=Expansion(patch=10, per_second=1)).first()
    assert [a.tokens for a in small.attachments] == [18, 3]


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (5, 2, "assistant", "same"), (5, 2, "assistant", "same"), (5, 2, "assistant", None), (5, 1, "user", "x" * 200_000)]
    turns = spark.createDataFrame([(*r, "b", "h", "n", "m") for r in rows], TURNS + ", body string, head string, nth string, mask string")
    got = {r.conv_id: r for r in op11_chat(turns).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[None][1:3] == (2, digest("\n\nuser\na\n")) and got[None].loss_chars == 0 and got[None].loss_sha256 == digest("")
    assert got[5].n_turns == 4 and got[5].turns_sha256 == digest("user\n" + "x" * 200_000 + "\nassistant\n\nassistant\nsame\nassistant\nsame\n") and got[5].loss_chars == 8
    assert got[-7].loss_sha256 == digest(SAMPLE) and got[-7].turns_sha256 == digest(f"user\n{SAMPLE}\nassistant\n{SAMPLE}\n") and len(got) == 3
    assert {r.conv_id for r in op11_chat(turns.where("false")).collect()} == {-7}


def test_time_is_linear_in_a_conversation(spark):
    took = []
    for n in (1_000, 20_000, 40_000):  # the first warms up
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("é <turn x "), 20).alias("text"))
        began = time.time()
        row = next(r for r in op11_chat(turns).collect() if r.conv_id == 1)
        took.append(time.time() - began)
        assert row.n_turns == n and row.loss_chars == n // 2 * 200
    assert took[2] < 3 * took[1] + 2 and took[2] < 20, took
