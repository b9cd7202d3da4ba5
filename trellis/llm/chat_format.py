"""Conversations as training strings, from Spark expressions only.

Turns of a conversation are collected as structs and sorted, runs of one role become one block, and blocks are
concatenated:

    <|im_start|>role\\ntext<|im_next|>text<|im_end|>\\n

A `~` escape keeps every control string of this and other common templates out of texts and roles; unescape() undoes
it exactly. The loss mask is an array of (start, length) over the string's code points, one for each text of the
assistant, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, NEXT, STOP = "<|im_start|>", "<|im_next|>", "<|im_end|>"
_ANGLE = r"<(?=/?s>|</?SYS>>|/?SYS>>|\|[A-Za-z0-9_]+\|>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """No control string is left in the result: `<` of one becomes ~1, `[` ~2, a ~ before a digit 0-3 ~0."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "~(?=[0-3])", "~0")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "~1"), _SQUARE, "~2")


def unescape(text: Column) -> Column:
    """What escape() was given."""
    for mark, plain in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """Columns conv_id, formatted, loss_mask (array of start, length from 0) for `turns` (conv_id, turn, role, text).

    Rows of a conversation are ordered by turn, then role, then text, nulls first; repeated rows stay. A null text or
    role is empty, a null conv_id is a conversation of its own. Other columns are ignored; an empty table gives no rows.
    One exchange by conv_id serves all steps. Each conversation is one string in the end, as the task has it.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~3"))
    rows = rows.select(
        "conv_id", "role",
        F.row_number().over(by).alias("n"),
        (F.lag("role").over(by).isNull() | (F.lag("role").over(by) != F.col("role"))).alias("opens"),
        (F.lead("role").over(by).isNull() | (F.lead("role").over(by) != F.col("role"))).alias("closes"),
        escape(F.col("text")).alias("body"),
    )
    rows = rows.select(
        "conv_id", "n", "role", "body",
        F.when(F.col("opens"), F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(NEXT)).alias("before"),
        F.when(F.col("closes"), F.lit(STOP + "\n")).otherwise(F.lit("")).alias("after"),
    )
    size = F.length("before") + F.length("body") + F.length("after")
    so_far = F.coalesce(F.sum(size.cast("long")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", so_far + F.length("before"))
    turn = F.struct("n", "role", F.concat("before", "body", "after").alias("piece"), "start", F.length("body").cast("long").alias("length"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return sorted_.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted string: array of (role, text), unescaped, one for each turn that went in."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    pieces = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1), r"<\|im_next\|>"),
            lambda t: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
        ),
    )
    return F.flatten(pieces)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
