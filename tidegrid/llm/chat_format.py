r"""Chat formatting with prefix-target expansion, in built-in functions only.

Template of a turn::

    ### role ###
    text</turn>

In role and text ``\`` becomes ``\\``, ``#`` becomes ``\#`` and ``</`` becomes
``<\/``; so neither ``###`` nor ``</turn>`` can occur inside them, and dropping
the escaping backslashes gives the text back.

A conversation is stored once, as numbered blocks of at most ``BLOCK`` turns.
Every assistant turn is one example. Its context (all earlier turns) is the
first ``context_chars`` characters of the formatted conversation and its
trainable reply is the span ``target_start``..``target_end``; a prefix is named
by its length, because written out the prefixes of a conversation grow with
the square of its turns. ``examples_as_text`` writes them out.

Nulls and edges: a null text or role counts as empty; turns with the same
number follow by role, then text; null turns come first; rows with a null
``conv_id`` form one conversation; repeated rows are repeated turns; an empty
table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256
OPEN, HEAD_END, CLOSE = "### ", " ###\n", "</turn>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("#"), F.lit("\\#"))
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class Formatted:
    """conversations: conv_id, block, n_turns, formatted, block_start (offset of its first character);
    examples: conv_id, block, turn_no, context_chars, target_start, target_end (code points of the
    formatted conversation)."""

    conversations: DataFrame
    examples: DataFrame


def _with_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that also matches null keys."""
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [a[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    return a.join(right, on, how).drop(*[f"__{k}" for k in keys])


def format_chat(turns: DataFrame, assistant: str = "assistant", block: int = BLOCK) -> Formatted:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # Blocks go by the turn number, so a conversation of any length is spread before it is sorted.
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(2**62))) / F.lit(block)))
    segment = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END), escape(F.col("text")), F.lit(CLOSE))
    entry = F.struct("turn", "role", "text", segment.alias("segment"), (F.col("role") == assistant).alias("reply"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    blocks = blocks.select(
        "conv_id", "block", F.size("entries").cast("long").alias("n_turns"), "entries",
        F.array_join("entries.segment", "").alias("formatted"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lengths = blocks.select("conv_id", "block", "n_turns", F.length("formatted").cast("long").alias("n"))
    starts = lengths.select(
        "conv_id", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("block_start"),
        F.coalesce(F.sum("n_turns").over(before), F.lit(0).cast("long")).alias("turns_before"),
    )
    placed = _with_same(blocks, starts, ["conv_id", "block"])
    # Running offsets inside one block of turns.
    offsets = F.aggregate(
        "entries",
        F.array(F.col("block_start")),
        lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(e["segment"]))),
    )
    exploded = placed.select("conv_id", "block", "turns_before", F.posexplode(F.arrays_zip(
        F.transform("entries", lambda e: F.struct(e["reply"], F.length(escape(e["role"])).alias("role_chars"),
                                                  F.length(escape(e["text"])).alias("text_chars"))).alias("entry"),
        F.slice(offsets, F.lit(1), F.size("entries")).alias("offset"))).alias("i", "e"))
    start = F.col("e.offset") + F.lit(len(OPEN) + len(HEAD_END)) + F.col("e.entry.role_chars")
    examples = exploded.filter(F.col("e.entry.reply")).select(
        "conv_id", "block", (F.col("turns_before") + F.col("i")).alias("turn_no"),
        F.col("e.offset").alias("context_chars"), start.alias("target_start"),
        (start + F.col("e.entry.text_chars")).alias("target_end"),
    )
    return Formatted(placed.select("conv_id", "block", "n_turns", "formatted", "block_start"), examples)


def examples_as_text(formatted: Formatted) -> DataFrame:
    """conv_id, turn_no, context, target, both still in the template: the examples written out."""
    whole = formatted.conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "formatted"))).alias("parts"),
    ).select("conv_id", F.array_join("parts.formatted", "").alias("whole"))
    length = (F.col("target_end") - F.col("target_start")).cast("int")
    return _with_same(formatted.examples, whole, ["conv_id"]).select(
        "conv_id", "turn_no",
        F.substring("whole", F.lit(1), F.col("context_chars").cast("int")).alias("context"),
        F.substring("whole", (F.col("target_start") + 1).cast("int"), length).alias("target"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text."""
    parts = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, F.lit(HEAD_END)) - F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit(HEAD_END)) + F.lit(len(HEAD_END)), F.length(p))).alias("text"),
    ))


def read_back(formatted: Formatted) -> DataFrame:
    """One row per conversation, computed from the formatted text and the examples alone.

    A context that does not end at the head of its example's own turn is an error.
    """
    turns = read_turns(F.col("formatted"))
    listed = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    blocks = formatted.conversations.select("conv_id", "block", "block_start", "formatted")
    # The reply of an example is cut from the stored text by its span, never taken from the input.
    grouped = formatted.examples.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("target_start", "target_end", "context_chars"))).alias("spans"))
    with_spans = _with_same(blocks, grouped, ["conv_id", "block"], "left")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(F.col("formatted"), (start - F.col("block_start") + 1).cast("int"), (end - start).cast("int"))

    def reply(s: Column) -> Column:
        # Escaping keeps both marks out of roles and texts, so only the turn's own head fits.
        head, body = cut(s["context_chars"], s["target_start"]), cut(s["target_start"], s["target_end"])
        own = (s["context_chars"] >= F.col("block_start")) & head.startswith(OPEN) & (
            F.instr(head, F.lit(HEAD_END)) == F.length(head) - F.lit(len(HEAD_END) - 1)) & ~head.contains(CLOSE)
        return F.when(own, unescape(body)).otherwise(F.raise_error(F.lit("a context does not end at its own turn")))

    spans = "array<struct<target_start:bigint,target_end:bigint,context_chars:bigint>>"
    replies = F.array_join(F.transform(F.coalesce("spans", F.array().cast(spans)), reply), "")
    per_block = with_spans.select(
        "conv_id", "block", F.size(turns).cast("long").alias("n_turns"), listed.alias("listed"),
        replies.alias("replies"), F.length("formatted").cast("long").alias("chars"))
    whole = per_block.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "listed", "replies"))).alias("parts"))
    replied = F.array_join("parts.replies", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.listed", ""), 256).alias("turns_sha256"),
        F.length(replied).cast("long").alias("loss_chars"), F.sha2(replied, 256).alias("loss_sha256"),
        "formatted_chars",
    )
