"""Chat formatting with Spark expressions only.

Rows of a conversation are collected as structs and sorted by turn (ties: role,
text), adjacent rows of one role are merged into one block by array aggregation,
and the blocks are concatenated:

    <turn ROLE>TEXT</turn>            one row
    <turn ROLE>TEXT<turn+>TEXT</turn> two adjacent rows of one role

Inside a text ``\\`` becomes ``\\\\`` and ``<turn``, ``</turn`` become ``<\\turn``,
``<\\/turn``, so no control string occurs in a text and dropping each first
backslash of a pair gives the text back. Roles are percent-encoded in ``%<>``.

A conversation has to meet in one row, as its output is one string; map-side
nothing else is gathered. Null text and null role count as empty strings, null
turns sort first, rows with a null conversation id form a conversation of their
own, repeated rows stay (each is a turn), an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalar import let

NEXT, END = "<turn+>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(/?turn)", "<\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for raw, enc in (("%", "%25"), ("<", "%3C"), (">", "%3E")):
        role = F.replace(role, F.lit(raw), F.lit(enc))
    return role


def unescape_role(role: Column) -> Column:
    for raw, enc in ((">", "%3E"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(enc), F.lit(raw))
    return role


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: id, formatted string, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one for each
    text of ``loss_role``; they cover the escaped text and nothing between texts.
    """
    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_t"),
    )
    chats = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    # Each row with how it opens (a new block or the next part of one), its text and how it ends.
    def parts(t: Column) -> Column:
        n = F.size(t)
        same = lambda i, j: F.get(t, i)["role"] == F.get(t, j)["role"]
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.when((i > 0) & same(i, i - 1), F.lit(NEXT)).otherwise(F.concat(F.lit("<turn "), escape_role(F.get(t, i)["role"]), F.lit(">"))).alias("open"),
                escape(F.get(t, i)["text"]).alias("text"),
                F.when((i + 1 < n) & same(i, i + 1), F.lit("")).otherwise(F.lit(END)).alias("end"),
                (F.get(t, i)["role"] == loss_role).alias("loss"),
            ),
        )

    # Running lengths by a linear aggregation: (where the next part starts, spans so far).
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["open"])
        size = F.length(p["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.length(p["end"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    both = let(
        parts(F.col("_turns")),
        lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["open"], x["text"], x["end"])), "").alias("formatted"),
            F.aggregate(p, zero, step)["spans"].alias("loss_spans"),
        ),
    )
    return chats.select(F.col("_conv").alias(conv_col), both.alias("_b")).select(conv_col, "_b.formatted", "_b.loss_spans")


def parse_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: id, turns (role, text), loss_text.

    ``turns`` come from the string alone; ``loss_text`` is what lies under the spans.
    """
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.locate(">", b) + 1, F.length(b)), "<turn\\+>"),
                lambda t: F.struct(unescape_role(F.substring(b, F.lit(7), F.locate(">", b) - 7)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select(conv_col, "formatted", turns.alias("turns"), loss.alias("loss_text"))
