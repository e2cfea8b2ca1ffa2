"""Chat formatting with typed content parts; DataFrame operations only.

A visitor flattens a turn's parts in order: text parts are escaped, and image, audio and
document parts become placeholders, whose references and expanded token counts are recorded.
A turn is ``<|turn|>role<|body|>content<|end|>``; a loss span covers an assistant's content.

Escaping puts a backslash after every ``<``, ``[`` and backslash of a text. So no control string
that starts with ``<`` or ``[`` (this template's, or another's such as ``</s>`` or ``[INST]``)
can come from a text, and taking the backslashes out again gives the text exactly.

Null texts and roles count as empty, an unknown part type as a document, a null list of parts
as no parts. Turns are ordered by turn (null first), then role and content, so equal turn
numbers and repeated rows have one order; each repeated row is a turn of its own. A null
conv_id is a conversation. Texts are taken whole, however long. Other columns are ignored, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>"}
DOCUMENT = "<|document|>"
PART = "struct<type: string, text: string, ref: string, tokens: long>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in "<[":
        out = F.replace(out, F.lit(c), F.lit(c + "\\"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as the one part of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """What stands for a part in the content."""
    out = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(DOCUMENT))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` (conv_id, turn, role, parts) as one row a conversation.

    Returns conv_id, formatted, turn_starts (code points), loss_spans (one a turn: start and length
    in code points, length 0 outside the loss), attachments in order (type, ref, tokens) and
    expanded_tokens, the tokens that the placeholders stand for.
    """
    parts = F.coalesce(F.col("parts"), F.expr(f"cast(array() as array<{PART}>)"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select(
        "conv_id", "turn", "role", F.array_join(F.transform("parts", visit), "").alias("content"),
        F.transform(F.filter("parts", lambda p: ~_is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens"))).alias("attached"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.select("conv_id", "turn", "role", "content", "attached", F.concat(head, F.col("content"), F.lit(END)).alias("piece"), F.length(head).cast("long").alias("head"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    span = F.struct((F.col("start") + F.col("head")).alias("start"), F.when(F.col("role") == loss_role, F.length("content")).otherwise(0).cast("long").alias("length"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece", span.alias("span"), "attached"))).alias("t"))
    attachments = F.flatten(F.col("t.attached"))
    return grouped.select(
        "conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.start").alias("turn_starts"), F.col("t.span").alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``format_chat``'s output alone: conv_id, turns (role, text) and the text under the loss mask, unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2**31 - 1)
    rows = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.arrays_zip(pieces.alias("piece"), F.col("turn_starts").alias("start"), F.col("loss_spans").alias("span")).alias("t"))
    body = lambda p: F.substring_index(F.element_at(F.split(p, r"<\|body\|>"), 2), END, 1)
    turns = F.transform("t", lambda t: F.struct(unescape(F.substring_index(t["piece"], BODY, 1)).alias("role"), unescape(body(t["piece"])).alias("text")))
    masked = F.transform("t", lambda t: unescape(F.substring(F.concat(F.lit(TURN), t["piece"]), (t["span"]["start"] - t["start"] + 1).cast("int"), t["span"]["length"].cast("int"))))
    return rows.select("conv_id", "formatted_chars", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
