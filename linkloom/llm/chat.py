"""Chat formatting with typed content parts, in DataFrame expressions alone.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens them in order: text is escaped,
every other part becomes a placeholder, and its reference and expanded token count are recorded. Turns are marked by
control strings; control strings inside texts are escaped so that unescaping gives the text back exactly.

Turns are first joined to segments (SEGMENT consecutive turn numbers), then segments to conversations; a conversation
with very many turns is thus formatted by many tasks, and only its finished segments meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window

SEGMENT = 64
#: Characters of the pieces in which a formatted text is cut to read spans of it.
PIECE = 4096

# The template's control strings.
START, END, HEADER_END = "<|im_start|>", "<|im_end|>", "\n"
NEWLINE_IN_ROLE = "<|nl|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

# What begins a control string of this template or of other common ones; a caret more or less after its first character escapes it.
CONTROL = r"([<\[])(\^*)(\||/?s>|/?INST\]|</?SYS>>)"
CONTROL_ESCAPED = r"([<\[])(\^*)\^(\||/?s>|/?INST\]|</?SYS>>)"

PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1$2^$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))).cast(PARTS)


def flatten(parts: Column) -> Column:
    """Visit the parts in order: the content with placeholders. A part of unknown type shows its text; null parts are empty."""
    def visit(p: Column) -> Column:
        shown = escape(F.coalesce(p["text"], F.lit("")))
        for kind, mark in PLACEHOLDER.items():
            shown = F.when(p["type"] == kind, F.lit(mark)).otherwise(shown)
        return shown

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit), "")


def attachments(parts: Column) -> Column:
    """The parts that became placeholders, in order, with reference and expanded token count (null: 1)."""
    kept = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["type"].isin(*PLACEHOLDER))
    return F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).cast("bigint").alias("tokens")))


_PART_FIELDS = ("type", "text", "ref", "tokens")


def _fields(kind: DataType) -> set[str]:
    return set(kind.elementType.names) if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else set()


def segments(turns: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns: conv_id, turn, role, and parts or else text. One row for each conversation and segment: formatted, loss_spans
    (start and length in code points of formatted, one for each turn under the loss), n_turns, attachments.

    A column `parts` that is no list of typed parts (type, text, ref, tokens) plays no part. Turns come by number, nulls first, then by role and content; repeated rows stay repeated. Null role: empty role; null
    text or parts: empty content. Rows with a null conv_id form a conversation of their own. Extra columns play no part.
    An empty table gives an empty one.
    """
    typed = "parts" in turns.columns and set(_PART_FIELDS) <= _fields(turns.schema["parts"].dataType)
    parts = F.transform("parts", lambda p: F.struct(*(p[f].alias(f) for f in _PART_FIELDS))).cast(PARTS) if typed else text_part(F.col("text").cast("string"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE_IN_ROLE)), F.lit(HEADER_END))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        flatten(parts).alias("body"), head.alias("head"), attachments(parts).alias("attached"),
    )
    piece = F.struct("turn", "role", "body", "head", "attached")
    grouped = rows.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    tail = F.lit(END + "\n")
    whole = F.transform("p", lambda x: F.concat(x["head"], x["body"], tail))
    sizes = F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["role"].isin(*learn_roles).alias("learn")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        here = F.array(F.struct((acc["at"] + x["h"]).alias("start"), x["b"].cast("bigint").alias("length")))
        spans = F.when(x["learn"], F.concat(acc["spans"], here)).otherwise(acc["spans"])
        return F.struct((acc["at"] + x["h"] + x["b"] + F.lit(len(END) + 1)).cast("bigint").alias("at"), spans.alias("spans"))

    return grouped.select(
        "conv_id", "segment", F.array_join(whole, "").alias("formatted"),
        F.aggregate(sizes, start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.size("p").cast("long").alias("n_turns"), F.flatten(F.transform("p", lambda x: x["attached"])).alias("attachments"),
    )


def conversations(parts: DataFrame) -> DataFrame:
    """Segments joined to conversations: conv_id, formatted, loss_spans, n_turns, attachments, expanded_tokens."""
    before = F.sum(F.length("formatted").cast("bigint")).over(Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("at", F.coalesce(before, F.lit(0).cast("bigint")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "formatted", "loss_spans", "n_turns", "attachments", "at"))).alias("s"))
    # each span moves by what stands before its segment: linear in the turns
    moved = F.transform("s", lambda x: F.transform(x["loss_spans"], lambda s: F.struct((s["start"] + x["at"]).alias("start"), s["length"].alias("length"))))
    attached = F.flatten(F.transform("s", lambda x: x["attachments"]))
    return whole.select(
        "conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"),
        F.flatten(moved).alias("loss_spans"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + x["n_turns"]).alias("n_turns"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"]).alias("expanded_tokens"),
    )


def format_chats(turns: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation; see segments() and conversations()."""
    return conversations(segments(turns, learn_roles))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of role and text (placeholders stay)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: F.length(b) > 0)

    def turn(b: Column) -> Column:
        role = unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(NEWLINE_IN_ROLE), F.lit("\n")))
        body = F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span. The formatted text is cut into pieces once, so that a span
    costs its own length and not that of all before it."""
    def span(pieces: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / PIECE), F.floor((s["start"] + s["length"]) / PIECE)
        around = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(F.substring(around, (s["start"] % PIECE + 1).cast("int"), s["length"].cast("int")))

    # bound as one element, the pieces are made once and not for each span
    one = F.array(F.struct(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), loss_spans.alias("spans")))
    return F.get(F.transform(one, lambda x: F.array_join(F.transform(x["spans"], lambda s: span(x["pieces"], s)), "")), F.lit(0))
