"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes one string of marked turns::

    ### <role>: <text></turn>\\n

Roles and texts are escaped so that neither marker can occur inside them: a backslash becomes
``\\b``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l`` (in roles also ``:``, as ``\\c``). After that
every backslash starts one of these sequences, so replacing them back in the order l, h, c, b
restores the text exactly.

Every assistant turn is an example: all turns before it are its context, and only its own text is
trainable. The examples of a conversation share its string: an example is its prefix up to the end
of its target, and the loss mask is the span of the target's text. Storing offsets keeps the output
linear in the input, where written-out prefixes would grow with the square of the turns;
``examples`` writes them out one row at a time.

Defined cases: a null text or role counts as empty; turns sort by turn (null first), then role,
then text; repeated rows stay, each a turn of its own; a null conv_id is one conversation; one
without assistant turns has no examples and an empty mask; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for plain, mark in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, examples: array of (number, target_start, loss_start, loss_end, end).

    Offsets are code points from 0, ends exclusive; ``end`` is the end of the target turn.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    marked = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE)).alias("head"),
            escape(F.col("text")).alias("body"),
        ).alias("t"),
    )
    grouped = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    placed = grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            "ts", lambda t: F.struct((t["role"] == ASSISTANT).alias("own"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"))
        ).alias("sizes"),
    )
    # running offsets: one pass over the turns that appends an example for each assistant turn
    start = F.struct(
        F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<number:int,target_start:int,loss_start:int,loss_end:int,end:int>>)").alias("found"),
    )

    def step(acc: Column, t: Column) -> Column:
        head_end = acc["at"] + t["head"]
        body_end = head_end + t["body"]
        end = body_end + F.lit(len(END))
        example = F.struct(
            F.size(acc["found"]).alias("number"), acc["at"].alias("target_start"), head_end.alias("loss_start"), body_end.alias("loss_end"), end.alias("end")
        )
        found = F.when(t["own"], F.concat(acc["found"], F.array(example))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return placed.select("conv_id", "formatted", F.aggregate("sizes", start, step, lambda acc: acc["found"]).alias("examples"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn, written out: conv_id, number, text (context and target), loss_start, loss_end."""
    return formatted.select("conv_id", "formatted", F.explode("examples").alias("e")).select(
        "conv_id", F.col("e.number").alias("number"), F.substring("formatted", F.lit(1), F.col("e.end")).alias("text"), F.col("e.loss_start").alias("loss_start"), F.col("e.loss_end").alias("loss_end")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    cut = lambda p: F.instr(p, F.lit(MIDDLE))  # noqa: E731  a role holds no colon once escaped
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(HEAD) + 1), cut(p) - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )
