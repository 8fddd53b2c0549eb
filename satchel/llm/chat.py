"""Chat formatting with Spark expressions only.

A conversation's turns are sorted as structs (turn, role, text); adjacent turns of one
role form a block.  The template:

    ### user: first text</also>second text of the same role</turn>
    ### assistant: answer</turn>

Control strings inside roles and texts are escaped reversibly: ``\\`` as ``\\b``, ``###`` as
``\\h``, ``</turn>`` as ``\\e``, ``</also>`` as ``\\a`` and, in roles, ``:`` as ``\\c``.  In an escaped
text a backslash only begins such a pair, so the replacements can be undone one by one.

The loss mask covers the escaped texts of the roles that are learned, one by one.  It comes
as ``segments``, the formatted text in order with a flag for each part, and as
``loss_spans`` (code points, end exclusive) over the formatted text.

Null texts and roles are empty.  Turns with equal numbers come in the order of role and
text, null numbers first; repeated rows are repeated turns.  Rows without conversation id
form one conversation with a null id.  No rows: no conversations.  A formatted
conversation is one value and so one row; only rows of its own meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satchel.llm.common import running_sums

END, ALSO, HEAD = "</turn>\n", "</also>", "### "
# Escapes, backslash first.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("</also>", "\\a"))
COLON = (":", "\\c")


def _literal(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    for old, new in (*ESCAPES, *([COLON] if role else [])):
        text = _literal(text, old, new)
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for old, new in reversed((*ESCAPES, *([COLON] if role else []))):
        text = _literal(text, new, old)
    return text


def format_conversations(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, segments, loss_spans`` for ``turns(conv_id, turn, role, text)``."""
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    t = F.col("turns")

    def piece(x: Column, i: Column) -> Column:
        # element_at counts from 1, so i is the turn before.
        begins = (i == 0) | (F.element_at(t, F.greatest(i, F.lit(1)))["role"] != x["role"])
        head = F.concat(F.when(i > 0, END).otherwise(""), F.lit(HEAD), escape(x["role"], role=True), F.lit(": "))
        return F.struct(F.when(begins, head).otherwise(ALSO).alias("head"), escape(x["text"]).alias("body"),
                        x["role"].isin(*learned).alias("loss"))

    pieces = sorted_.select("conv_id", F.transform(t, piece).alias("p"))
    sized = pieces.withColumn("at", running_sums(F.transform("p", lambda p: F.length(p["head"]) + F.length(p["body"]))))
    spans = F.transform(F.filter(F.arrays_zip("p", "at"), lambda z: z["p"]["loss"]), lambda z: F.struct(
        (z["at"] + F.length(z["p"]["head"])).alias("start"),
        (z["at"] + F.length(z["p"]["head"]) + F.length(z["p"]["body"])).alias("end")))
    text = F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))
    segments = F.concat(
        F.flatten(F.transform("p", lambda p: F.array(F.struct(p["head"].alias("text"), F.lit(False).alias("loss")),
                                                     F.struct(p["body"].alias("text"), p["loss"].alias("loss"))))),
        F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    return sized.select("conv_id", text.alias("formatted"), segments.alias("segments"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turns_of(block: Column) -> Column:
        role = F.regexp_extract(block, r"(?s)^### ([^:]*): ", 1)
        texts = F.split(F.substring(block, F.length(role) + len(HEAD) + 3, F.length(block)), ALSO)
        return F.transform(texts, lambda x: F.struct(unescape(role, role=True).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), turns_of))


def summary(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and its mask."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
