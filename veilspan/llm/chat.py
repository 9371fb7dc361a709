"""Chat formatting with typed content parts, by DataFrame functions alone.

A turn's content is a list of typed parts.  A visitor (an expression per part type) flattens it to
text: text parts as they are, escaped; image, audio and document parts as placeholders, numbered by
type through the conversation in order, with the attachment's reference and the number of tokens
that the placeholder expands to recorded beside.

Template: an assistant turn is ``<s>text</s>``, any other turn ``[ROLE]role[INST]text[/INST]``.  A conversation is its turns, one after the other.

Escaping: a backslash is doubled, and one is put after the first character of every control string
(the five marks, and placeholders) inside a text or role, so no control string of the template can
come from a text.  Unescaping drops each backslash before the character that it protects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One content part: ``kind`` is text, image, audio or document; the other fields belong to some kinds.
PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
ATTACHED = ("image", "audio", "document")
#: Side of an image patch in pixels, audio tokens a second, tokens of a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512

_CONTROL = r"<(?=/?s>|(?:image|audio|document)_\d+>)|\[(?=/?INST\]|ROLE\])"
_TURN = r"(?<=</s>|\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A text as a list of one part."""
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in PART}
    null |= {"kind": F.lit("text").alias("kind"), "text": text.alias("text")}
    return F.array(F.struct(*[null[f.name] for f in PART]))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; 0 where its size isn't known."""
    sides = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["kind"] == "image", sides).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", part["pages"] * F.lit(PAGE_TOKENS)), F.lit(0)
    ).cast("long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and end in code points of
    every assistant text), attachments (kind, number, turn, uri, tokens; in order) and n_turns.

    ``turns`` has conv_id, turn, role and parts (``PART`` lists) or text.  Turns go by number, equal
    numbers by role and text, null numbers first; a null text is empty, a null role is the empty
    role, null conversation ids form one conversation; part types other than the four, and null
    parts, are empty text.  Other columns are ignored, whatever they are called.  An empty table
    gives no row.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART))) if "parts" in turns.columns else text_part(F.col("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # every attachment of the conversation in order, then its number within its kind
    kinds = F.array(*[F.lit(k) for k in ATTACHED])
    found = F.flatten(
        F.transform("turns", lambda t, i: F.transform(t["parts"], lambda p, j: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens"), t["turn"].alias("turn"), i.alias("at_turn"), j.alias("at_part"))))
    )
    found = F.filter(found, lambda a: F.array_contains(kinds, a["kind"]))
    grouped = grouped.withColumn("found", found)
    numbered = F.transform(
        "found", lambda a, i: F.struct(a["kind"].alias("kind"), F.size(F.filter(F.slice(F.col("found"), F.lit(1), i + 1), lambda b: b["kind"] == a["kind"])).alias("number"), a["turn"].alias("turn"), a["uri"].alias("uri"), a["tokens"].alias("tokens"), a["at_turn"].alias("at_turn"), a["at_part"].alias("at_part"))
    )
    grouped = grouped.withColumn("found", numbered)

    def visit(t: Column, i: Column) -> Column:
        """The flat text of a turn."""

        def one(p: Column, j: Column) -> Column:
            a = F.filter(F.col("found"), lambda x: (x["at_turn"] == i) & (x["at_part"] == j))
            held = F.concat(F.lit("<"), F.element_at(a, 1)["kind"], F.lit("_"), F.element_at(a, 1)["number"].cast("string"), F.lit(">"))
            return F.when(p["kind"] == "text", F.coalesce(escape(p["text"]), F.lit(""))).when(F.array_contains(kinds, p["kind"]), held).otherwise(F.lit(""))

        return F.array_join(F.transform(t["parts"], one), "")

    flat = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), visit(t, i).alias("text")))
    grouped = grouped.withColumn("flat", flat)
    shown = F.transform(
        "flat", lambda t: F.when(t["role"] == "assistant", F.concat(F.lit("<s>"), t["text"], F.lit("</s>"))).otherwise(F.concat(F.lit("[ROLE]"), escape(t["role"]), F.lit("[INST]"), t["text"], F.lit("[/INST]")))
    )
    grouped = grouped.withColumn("shown", shown)
    # where each turn starts: the lengths before it, summed in one fold
    starts = F.aggregate(
        "shown",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, s: F.struct((acc["at"] + F.char_length(s)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )["starts"]
    grouped = grouped.withColumn("starts", starts)
    spans = F.filter(
        F.transform("flat", lambda t, i: F.when(t["role"] == "assistant", F.struct((F.get(F.col("starts"), i) + 3).alias("start"), (F.get(F.col("starts"), i) + 3 + F.char_length(t["text"])).alias("end")))), lambda s: s.isNotNull()
    )
    attachments = F.transform("found", lambda a: F.struct(a["kind"].alias("kind"), a["number"].alias("number"), a["turn"].alias("turn"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    return grouped.select("conv_id", F.array_join("shown", "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"), F.size("turns").cast("long").alias("n_turns"))


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    pieces = F.filter(F.split(formatted, _TURN), lambda p: p != "")
    role = lambda p: F.substring_index(p, "[INST]", 1)
    return F.transform(
        pieces,
        lambda p: F.when(p.startswith("<s>"), F.struct(F.lit("assistant").alias("role"), unescape(F.substr(p, F.lit(4), F.char_length(p) - 7)).alias("text"))).otherwise(
            F.struct(unescape(F.substr(role(p), F.lit(7))).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + 7, F.char_length(p) - F.char_length(role(p)) - 13)).alias("text"))
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
