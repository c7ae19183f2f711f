"""Operator 9, chat formatting with typed content parts.

A message's content is an ordered array of typed parts. One visitor per type flattens them: text is
escaped and copied, an image, audio or document part becomes a placeholder marker, and its
reference, place and expanded token count are recorded in ``attachments``. Messages are joined by
control markers into one string per conversation, with the loss mask as (start, length) spans of
code points over the assistant's text.

Every marker begins with ``<|``. Inside texts and roles ``<|`` is written ``<\\|`` and a backslash is
doubled, so an escaped text never holds ``<|`` and each backslash starts a pair: reading back splits
on the plain markers and drops the first backslash of each pair. Built-in functions only.

Defined results: null text, role or parts count as empty; turns go by turn (null last), then role,
then text; repeated turns are all kept; a null conversation id is one conversation; an empty table
gives no rows; parts of an unknown type are formatted as documents with no pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Image tokens: one per 28 x 28 patch; audio: 25 a second; documents: 1,500 a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1500
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast(f"array<struct<type:string,text:string>>")


def _visit(part: Column, fields: list[str]) -> Column:
    """struct(out, type, ref, tokens) of one part; ``fields`` are those that the parts carry."""
    get = lambda name, kind: (part[name] if name in fields else F.lit(None)).cast(kind)
    kind = F.coalesce(part["type"], F.lit("text"))
    patches = F.ceil(F.coalesce(get("width", "long"), F.lit(0)) / PATCH) * F.ceil(F.coalesce(get("height", "long"), F.lit(0)) / PATCH)
    return F.struct(
        F.when(kind == "text", escape(get("text", "string"))).when(kind == "image", F.lit("<|image|>")).when(kind == "audio", F.lit("<|audio|>")).otherwise(F.lit("<|document|>")).alias("out"),
        kind.alias("type"),
        get("ref", "string").alias("ref"),
        F.when(kind == "text", F.lit(0)).when(kind == "image", patches).when(kind == "audio", F.ceil(F.coalesce(get("seconds", "double"), F.lit(0.0)) * AUDIO_RATE)).otherwise(F.coalesce(get("pages", "long"), F.lit(0)) * PAGE_TOKENS).cast("long").alias("tokens"),
    )


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv, formatted, loss_spans array<struct<start,len>>,
    attachments array<struct<turn,nth,type,ref,tokens>>, expanded_tokens``."""
    fields = messages.schema[parts_col].dataType.elementType.names
    seen = messages.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"),
        F.transform(F.coalesce(F.col(parts_col), F.array().cast(messages.schema[parts_col].dataType)), lambda p: _visit(p, fields)).alias("_parts"),
    )
    seen = seen.withColumn("_body", F.array_join(F.col("_parts.out"), ""))
    seen = seen.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(TEXT)))
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_body")
    length = F.length("_head") + F.length("_body") + F.lit(len(END))
    placed = seen.withColumn("_nth", F.row_number().over(order)).withColumn("_start", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length)
    others = F.filter("_parts", lambda p: p["type"] != "text")
    turn = F.struct(
        F.col("_nth").alias("nth"),
        F.concat("_head", "_body", F.lit(END)).alias("out"),
        F.when(F.col("_role") == learn, F.struct((F.col("_start") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("len"))).alias("loss"),
        F.transform(others, lambda p, i: F.struct(F.col("_nth").alias("turn"), i.alias("nth"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached"),
    )
    turns = placed.groupBy("_conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    attached = F.flatten(F.col("t.attached"))
    return turns.select(
        F.col("_conv").alias(conv_col),
        F.array_join(F.col("t.out"), "").alias("formatted"),
        F.filter(F.col("t.loss"), lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    halves = F.transform(turns, lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, one string per span."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int"))))
