"""Chat formatting with a grammar round trip, in built-in functions only.

    conversation := turn*
    turn         := OPENING role SEPARATOR text CLOSING

Neither role nor text may hold a reserved string. ``parsed`` reads a rendered text back by
this grammar. A turn whose parse is not its source is escaped: a backslash goes behind the
first character of everything that is a reserved string, or would be one without its
backslashes; the parser takes one such backslash away. So a turn without these strings is
rendered as it is, any other is recovered exactly, and escaping once is always enough.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    # Marks of the turns, and further strings that tokenizers treat as control.
    opening: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learned_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        heads = {mark[:1] for mark in self.marks}
        if "" in heads or any(set(mark[1:]) & (heads | {"\\"}) for mark in self.marks):
            raise ValueError("first characters of marks, and backslashes, may not occur later in a mark")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.opening, self.separator, self.closing, *self.reserved)

    def alternatives(self, form: str) -> str:
        return "|".join(form.format(head=re.escape(mark[0]), rest=re.escape(mark[1:])) for mark in self.marks)


CHAT = Template()


def escaped(value: Column, template: Template = CHAT) -> Column:
    """One backslash more in each reserved string, with or without backslashes already."""
    return F.regexp_replace(value, F.lit(template.alternatives(r"{head}(?=\\*{rest})")), F.lit(r"$0\\"))


def unescaped(value: Column, template: Template = CHAT) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(value, F.lit(template.alternatives(r"(?<={head})\\(?=\\*{rest})")), F.lit(""))


def block(role: Column, text: Column, template: Template = CHAT) -> Column:
    return F.concat(F.lit(template.opening), role, F.lit(template.separator), text, F.lit(template.closing))


def parsed(rendered: Column, template: Template = CHAT) -> Column:
    """The turns of a rendered text as ``array<struct<role, text>>``; what breaks the grammar is null."""
    raw = F.lit(template.alternatives("{head}{rest}"))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(1), F.length(piece) - F.lit(len(template.closing)))
        parts = F.split(body, re.escape(template.separator))
        sound = F.endswith(piece, F.lit(template.closing)) & (F.size(parts) == 2) & ~F.exists(parts, lambda part: F.rlike(part, raw))
        return F.when(
            sound,
            F.struct(
                unescaped(F.get(parts, F.lit(0)), template).alias("role"), unescaped(F.get(parts, F.lit(1)), template).alias("text")
            ),
        )

    pieces = F.split(rendered, re.escape(template.opening))
    before = F.get(pieces, F.lit(0)) == ""
    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)
    return F.when(before, turns)


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per ``conv_id`` from rows of ``conv_id, turn, role, text``.

    ``formatted`` is the rendered conversation, ``segments`` the same text in pieces that are
    wholly inside the loss mask (``loss`` true: the texts of learned roles) or outside of it.

    Turns come in the order of ``turn``, then role, then text, nulls first; repeated rows are
    turns of their own. A null role or text is an empty one. Rows with a null ``conv_id`` form
    one conversation. Further columns are not used. A conversation is one text in the end, so
    the rows of one meet in one task; they are the only rows that do.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    source = F.struct(role.alias("role"), text.alias("text"))
    turns = conversations.select("conv_id", "turn", source.alias("source"))
    role, text = F.col("source.role"), F.col("source.text")
    recovered = parsed(block(role, text, template), template)
    identical = F.coalesce((F.size(recovered) == 1) & (F.get(recovered, F.lit(0)) == F.col("source")), F.lit(False))
    raised = F.struct(escaped(role, template).alias("role"), escaped(text, template).alias("text"))
    body = F.when(identical, F.col("source")).otherwise(raised)
    gathered = (
        turns.withColumn("body", body)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "source", "body"))).alias("turns"))
    )

    def pieces(turn: Column) -> Column:
        def piece(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.opening), turn["body"]["role"], F.lit(template.separator))
        return F.array(
            piece(head, F.lit(False)),
            piece(turn["body"]["text"], turn["source"]["role"].isin(*template.learned_roles)),
            piece(F.lit(template.closing), F.lit(False)),
        )

    segments = F.flatten(F.transform("turns", pieces))
    return gathered.select(
        "conv_id",
        segments.alias("segments"),
        F.transform("turns", lambda turn: turn["source"]).alias("source"),
    ).select("conv_id", F.array_join(F.transform("segments", lambda piece: piece["text"]), "").alias("formatted"), "segments", "source")


def round_trips(chats: DataFrame, template: Template = CHAT) -> Column:
    """Whether the rendered conversation parses to its source turns."""
    return F.coalesce(parsed(F.col("formatted"), template) == F.col("source"), F.lit(False))


def read_back(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the rendered output alone."""
    turns = chats.select(
        "conv_id",
        "formatted",
        parsed(F.col("formatted"), template).alias("turns"),
        F.transform(F.filter("segments", lambda piece: piece["loss"]), lambda piece: unescaped(piece["text"], template)).alias("loss"),
    )
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("loss", "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
