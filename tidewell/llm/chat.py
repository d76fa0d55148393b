"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. Turns after the last reply (or all turns, where nobody replies) end in one more
example without a target, so the output holds every turn.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside texts and roles, those of
this template and of other public ones, are broken by a backslash after their first character; a
backslash is doubled. ``unescape`` gives back the text exactly.

The last example of a conversation holds the whole conversation, so a conversation is a row's worth of
text by the operator's own definition; it is gathered once, by one shuffle. The output grows with the
square of a conversation's turns, as the expansion asks.

Defined results: null texts and roles are empty; a null conversation id is one conversation; turns
go by (turn, role, text), null turns first, so ties and repeated rows are kept in a fixed order; an
empty table gives no example; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings (or their beginnings) of public chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """One row an example: ``conv_id, n_context, formatted, loss_start, loss_chars, trainable, whole``.

    ``loss_start`` and ``loss_chars`` mark the trainable code points of ``formatted``; ``whole`` is true
    for the example that holds all turns of its conversation.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"),
            escape(F.col("text")).alias("body"),
            F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("reply"),
        ).alias("t"),
    )
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["reply"] | (i == n))
    each = held.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(STOP))).alias("done"),
        "turns",
        n.alias("n"),
        F.explode(targets).alias("i"),
    )
    cut = each.select(
        "conv_id",
        "i",
        (F.col("i") == F.col("n")).alias("whole"),
        F.array_join(F.slice("done", F.lit(1), F.col("i") - 1), "").alias("context"),
        F.element_at("turns", F.col("i")).alias("t"),
    )
    return cut.select(
        "conv_id",
        (F.col("i") - 1).alias("n_context"),
        F.concat("context", F.col("t.head"), F.col("t.body"), F.lit(STOP)).alias("formatted"),
        (F.char_length("context") + F.char_length("t.head")).cast("long").alias("loss_start"),
        F.when(F.col("t.reply"), F.char_length("t.body")).otherwise(0).cast("long").alias("loss_chars"),
        F.col("t.reply").alias("trainable"),
        "whole",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text."""
    parts = F.split(formatted, r"<\|im_end\|>")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, SEP, 1)
        return F.struct(
            unescape(F.substring(head, F.lit(len(START) + 1), F.char_length(head))).alias("role"),
            unescape(F.substring(x, F.char_length(head) + len(SEP) + 1, F.char_length(x))).alias("text"),
        )

    return F.transform(turns, turn)


def digests(made: DataFrame) -> DataFrame:
    """What the examples hold, a row a conversation, read back from their text and loss marks."""
    reply = F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    turns = F.when(F.col("whole"), read_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", "n_context", F.char_length("formatted").cast("long").alias("chars"), F.when(F.col("trainable"), unescape(reply)).alias("reply"), turns.alias("turns"))
    read = read.select("conv_id", "n_context", "chars", "reply", F.size("turns").cast("long").alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("sha"))
    held = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("n_context", "reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return held.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
