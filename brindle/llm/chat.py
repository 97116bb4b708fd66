"""Chat formatting over typed content parts.

A turn's content is an array of parts, each of a type: text, image, audio or
document. A visitor turns every part into a segment of the output: text is
escaped, the others become placeholders, in order, with their attachment's
reference and the number of tokens that the placeholder stands for. Turns are
then put together by a template that marks where each begins and ends, and the
spans that a loss applies to (the assistant's texts) are recorded.

Template: ``<|turn|>role<|text|>content<|end|>`` for each turn, one after
another. Escaping is reversible: within roles and texts a backslash follows
each ``<``, ``[`` and backslash, so that neither the template's own marks nor
other models' control strings (``</s>``, ``[INST]``, ``<|...|>``) can stand
there; ``unescape`` takes it away.

All expressions are native; a conversation's turns are gathered on its
identifier, as its one output row needs them.

Defined cases: a null text or role is empty; unknown part types are refused
with an error; turns with the same number are ordered by role and then
content, a null number comes first; rows of a null conversation form one
conversation; a conversation is one row, so all its turns, however many or
long, must fit one; repeated rows are turns of their own; an empty table gives
no rows; other columns are not read, so their names can't clash. ``parse``
gives back turns of texts; of other parts it shows the placeholders, which
``attachments`` tells apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hof import let, prefix_sums

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = "struct<shown:string,kind:string,ref:string,tokens:bigint>"
LOSS = "struct<start:bigint,end:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


class PartVisitor:
    """One method a part type; each gives a segment. Subclass it to change
    placeholders or the token counts they expand to."""

    patch = 14  # pixels of an image's side that one token covers
    audio_rate = 25  # tokens a second
    page_tokens = 256  # tokens a document page

    def text(self, part: Column) -> Column:
        return self.segment(escape(part["text"]), "text", F.lit(None), F.lit(0))

    def image(self, part: Column) -> Column:
        across, down = (F.ceil(F.coalesce(part[side], F.lit(self.patch)) / self.patch) for side in ("width", "height"))
        return self.segment(F.lit("<|image|>"), "image", part["ref"], across * down)

    def audio(self, part: Column) -> Column:
        return self.segment(F.lit("<|audio|>"), "audio", part["ref"], F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate))

    def document(self, part: Column) -> Column:
        return self.segment(F.lit("<|document|>"), "document", part["ref"], F.coalesce(part["pages"], F.lit(1)) * self.page_tokens)

    def segment(self, shown: Column, kind: str, ref: Column, tokens: Column) -> Column:
        return F.struct(shown.alias("shown"), F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens"))

    def visit(self, part: Column) -> Column:
        out = F.when(part["type"] == "text", self.text(part))
        for kind in ("image", "audio", "document"):
            out = out.when(part["type"] == kind, getattr(self, kind)(part))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(part["type"], F.lit("null")))).cast(SEGMENT))


def text_part(text: Column) -> Column:
    """A part array holding one text, for tables of plain texts."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()]))


def format_conversations(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", parts_column: str = "parts", loss_role: str = "assistant", visitor: PartVisitor | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments,
    expanded_tokens), a row for each conversation. Spans count code points of
    ``formatted``, end exclusive; attachments are (turn, at, kind, ref,
    tokens) in order, turn counted from 0 and at the placeholder's number."""
    visitor = visitor or PartVisitor()
    parts = F.coalesce(F.col(parts_column), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        F.col(conv_column).alias("conv_id"),
        F.struct(
            F.col(turn_column).alias("turn"),
            F.coalesce(role_column, F.lit("")).alias("role"),
            F.transform(parts, visitor.visit).alias("segments"),
        ).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    body = lambda t: F.array_join(F.transform(t["segments"], lambda s: s["shown"]), "")
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
            body(t).alias("body"),
            (t["role"] == loss_role).alias("learned"),
        ),
    )

    def built(p: Column) -> Column:
        spans = prefix_sums(
            F.transform(p, lambda x: F.struct(F.char_length(x["head"]).cast("long").alias("head"), F.char_length(x["body"]).cast("long").alias("body"), x["learned"].alias("learned"))),
            lambda x: x["head"] + x["body"] + len(END),
            lambda at, x: F.struct(F.when(x["learned"], at + x["head"]).alias("start"), (at + x["head"] + x["body"]).alias("end")),
            LOSS,
        )
        return F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
            F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss_spans"),
        )

    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(F.filter(t["segments"], lambda s: s["kind"] != "text"), lambda s: F.struct(i.alias("turn"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))))
    numbered = F.transform(attached, lambda a, k: F.struct(a["turn"].alias("turn"), k.alias("at"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    out = gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), let(pieces, built).alias("b"), numbered.alias("attachments"))
    return out.select("conv_id", "n_turns", "b.formatted", "b.loss_spans", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation: the reverse of
    formatting for conversations of texts."""
    turns = F.split(formatted, END.replace("|", r"\|"), -1)
    closed = let(turns, lambda t: F.slice(t, 1, F.size(t) - 1))

    def turn(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(TURN) + 1)), TEXT.replace("|", r"\|"), 2)
        return let(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))

    return F.transform(closed, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. A span is cut
    out of the turn that ends where it ends; ends are matched by sorting, so
    the work follows the text and not its length times the turns."""
    pieces = F.split(formatted, END.replace("|", r"\|"), -1)

    def cut(p: Column) -> Column:
        size = lambda x: F.char_length(x).cast("long")
        ends = prefix_sums(p, lambda x: size(x) + len(END), lambda at, x: at + size(x), "bigint")
        mark = lambda end, tag, of: F.struct(end.alias("end"), F.lit(tag).alias("tag"), of.cast("long").alias("of"))
        marks = F.array_sort(F.concat(F.transform(spans, lambda s: mark(s["end"], 0, s["start"])), F.transform(ends, lambda e, i: mark(e, 1, i))))

        def told(m: Column) -> Column:
            def text(x: Column, k: Column) -> Column:
                return let(
                    F.struct(F.get(m, k - 1).alias("span"), F.get(p, x["of"].cast("int")).alias("piece")),
                    lambda v: F.when(
                        (x["tag"] == 1) & (v["span"]["tag"] == 0) & (v["span"]["end"] == x["end"]),
                        let((x["end"] - v["span"]["of"]).cast("int"), lambda n: unescape(F.substr(v["piece"], F.char_length(v["piece"]) - n + 1, n))),
                    ),
                )

            return F.array_join(F.filter(F.transform(m, text), lambda t: t.isNotNull()), "")

        return let(marks, told)

    return let(pieces, cut)
