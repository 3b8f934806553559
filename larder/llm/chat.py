"""Chat formatting with relational operations: turns are collected, sorted, merged and joined to one text.

Template: ``<s>`` opens a conversation and ``</s>`` ends each block. A block holds adjacent turns of one role:
``<|role|>``, then the texts of the turns with ``<|+|>`` between them. The loss mask covers the texts of
the chosen role and nothing else, as run lengths of code points over the formatted text (outside, inside,
outside, ...).

Escaping is reversible: a backslash in a text or role becomes two; the first character of a control string
(``<s>``, ``</s>``, ``<|``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) becomes ``\\l`` for ``<`` and
``\\b`` for ``[``; in roles ``|`` becomes ``\\p``. So no control string comes from a text.

One conversation is one value and is built in one task: its length is bounded by Spark's limit for a
string. The sort key is (turn, role, text). Rows: null turn sorts first; null role and null text read as
empty; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column

OPEN, END, ROLE, ROLE_END, NEXT = "<s>", "</s>", "<|", "|>", "<|+|>"
_ANGLE = r"<(\||/?s>|<?/?SYS>>)"
_SQUARE = r"\[(/?INST\])"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, _ANGLE, r"\\l$1")
    out = F.regexp_replace(out, _SQUARE, r"\\b$1")
    return F.replace(out, F.lit("|"), F.lit("\\p")) if role else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are cut out first, so what is left holds single ones only."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\p"), F.lit("|")),
    )
    return F.array_join(parts, "\\")


def format_chats(
    turns: DataFrame,
    loss_role: str = "assistant",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, formatted, loss_runs), one row per conversation."""
    rows = turns.select(
        column(conv_col).alias("conv_id"),
        F.struct(
            column(turn_col).alias("turn"),
            F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    # positions where a block of one role begins; slices between them are the blocks
    begins = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i).getField("role") != F.element_at("turns", F.greatest(i - 1, F.lit(1))).getField("role")),
    )
    blocked = sorted_turns.withColumn("begins", begins).select(
        "conv_id",
        F.transform(
            F.arrays_zip(
                F.col("begins").alias("at"), F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns") + 1)).alias("end")
            ),
            lambda b: F.slice("turns", b["at"], b["end"] - b["at"]),
        ).alias("blocks"),
    )
    # pieces of the output with a flag: role mark and separators outside the loss, texts of the loss role inside
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda block: F.concat(
                F.flatten(
                    F.transform(
                        block,
                        lambda t, i: F.array(
                            F.struct(
                                F.when(i == 0, F.concat(F.lit(ROLE), escape(t["role"], role=True), F.lit(ROLE_END))).otherwise(F.lit(NEXT)).alias("text"),
                                F.lit(False).alias("loss"),
                            ),
                            F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))),
            ),
        )
    )
    head = F.array(F.struct(F.lit(OPEN).alias("text"), F.lit(False).alias("loss")))
    built = blocked.select("conv_id", F.concat(head, pieces).alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).alias("n"), p["loss"].alias("loss")))
    # runs end where the flag is about to change; a run's length is the sum of its pieces
    runs = F.aggregate(
        "lengths",
        F.expr("named_struct('done', cast(array() as array<int>), 'n', 0, 'loss', false)"),
        lambda acc, p: F.when(p["loss"] == acc["loss"], F.struct(acc["done"].alias("done"), (acc["n"] + p["n"]).alias("n"), acc["loss"].alias("loss"))).otherwise(
            F.struct(F.array_append(acc["done"], acc["n"]).alias("done"), p["n"].alias("n"), p["loss"].alias("loss"))
        ),
        lambda acc: F.array_append(acc["done"], acc["n"]),
    )
    return built.withColumn("lengths", lengths).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), runs.alias("loss_runs")
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    body = F.substring_index(formatted, OPEN, -1)
    blocks = F.filter(F.split(body, END), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, ROLE_END) + len(ROLE_END), F.length(b)), r"<\|\+\|>"),
                lambda text: F.struct(
                    unescape(F.substring_index(F.substring(b, F.lit(len(ROLE) + 1), F.length(b)), ROLE_END, 1)).alias("role"),
                    unescape(text).alias("text"),
                ),
            ),
        )
    )


def read_loss(formatted: Column, loss_runs: Column) -> Column:
    """Texts under the loss mask, in order."""
    spans = F.aggregate(
        loss_runs,
        F.expr("named_struct('at', 1, 'inside', false, 'spans', cast(array() as array<struct<at:int,n:int>>))"),
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.array_append(acc["spans"], F.struct(acc["at"].alias("at"), n.alias("n")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["at"], s["n"])))
