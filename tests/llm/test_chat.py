"""Chat formatting: exact round trips and typed parts."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import chat

HARD = ["</s>[INST] ok [/INST]", "a\\b<\\[", "<|end|><|turn|>x<|text|>", "", "é\U0001F600 <<SYS>>\n", "\\\\<", "[", "<\\"]


def test_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in HARD for r in ("user", "assistant"))] + [(2, 0, None, None), (None, 0, "assistant", "x"), (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, None, "a", "first"), (3, 1, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select("conv_id", "n_turns", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert got[1].learned == "".join(HARD)
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[3].turns] == [("a", "first"), ("a", "tie"), ("a", "tie"), ("b", "tie")]
    assert got[None].learned == "x" and len(got) == 4
    for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert control not in got[1].formatted


def test_parts_and_attachments(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    part = lambda kind, **f: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | f
    rows = [(1, 0, "user", [part("text", text="look "), part("image", ref="i1", width=28, height=15), part("text", text=" and"), part("audio", ref="a1", seconds=2.0)]), (1, 1, "assistant", [part("document", ref="d1", pages=3), part("text", text="ok")]), (2, 0, "user", None)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert [(a.turn, a.at, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, 0, "image", "i1", 4), (0, 1, "audio", "a1", 50), (1, 2, "document", "d1", 768)]
    assert got[1].expanded_tokens == 822 and "look <|image|> and<|audio|>" in got[1].formatted
    assert got[2].attachments == [] and got[2].n_turns == 1
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("video")])], schema)).collect()


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"é{i}<" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    r = chat.format_conversations(df).select("formatted", "loss_spans", chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("learned")).first()
    assert r.learned == "".join(t for _, _, role, t in rows if role == "assistant")
    assert [r.formatted[s.start : s.end].replace("<\\", "<") for s in r.loss_spans] == [t for _, _, role, t in rows if role == "assistant"]
