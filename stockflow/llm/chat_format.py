"""Conversations as training texts: a relation of turns in, one marked text with its loss mask out.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a
block, and the blocks are concatenated between marks, all of it by column functions. Control strings inside
texts get a backslash after their first character, so that a mark in the output is always one of the template,
and both the turns and what the mask covers can be read back exactly.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import known

#: Elements that running sums are taken over at a time; appending to a longer array would copy it too often.
STRETCH = 256


class Template(NamedTuple):
    """Marks of a block's start, of the end of its role, between texts merged into it, and of its end.

    ``controls`` are further strings that must not survive inside a text.
    """

    start: str = "<|im_start|>"
    body: str = "<|im_sep|>"
    join: str = "<|im_join|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    controls: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def escapable(self) -> list[str]:
        found = [self.start, self.body, self.join, self.end, *self.controls]
        for control in found:
            if len(control) < 2 or "\\" in control or control[0] in control[1:]:
                raise ValueError(f"{control!r}: a control string starts with a character that it has nowhere else, and has no backslash")
        return found


CHAT = Template()


def patterns(template: Template = CHAT) -> tuple[str, str]:
    """(what is escaped, what is unescaped): a control string with any number, or at least one, of backslashes in it."""
    controls = template.escapable()
    first = "[" + "".join(sorted({re.escape(c[0]) for c in controls})) + "]"
    rest = "|".join(sorted({re.escape(c[1:]) for c in controls}))
    return rf"({first})(\\*(?:{rest}))", rf"({first})\\(\\*(?:{rest}))"


def escaped(text: Column, template: Template = CHAT) -> Column:
    """The text with one backslash more in each control string. Escaping twice takes unescaping twice."""
    return F.regexp_replace(text, F.lit(patterns(template)[0]), F.lit(r"$1\\$2"))


def unescaped(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, F.lit(patterns(template)[1]), F.lit("$1$2"))


def _sums(values: Column) -> Column:
    nothing = F.array().cast("array<bigint>")
    return F.aggregate(
        values, nothing, lambda done, x: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))
    )


def with_running_sums(df: DataFrame, values: str, to: str) -> DataFrame:
    """Add the sums of an array column up to and including each element."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STRETCH))
    df = df.withColumn("_stretches", F.transform(starts, lambda at: _sums(F.slice(values, at, STRETCH))))
    df = df.withColumn("_before", _sums(F.transform("_stretches", lambda s: F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)))))
    moved = F.transform(
        "_stretches", lambda s, i: F.transform(s, lambda x: x + F.coalesce(F.get(F.col("_before"), i - 1), F.lit(0)))
    )
    return df.withColumn(to, F.flatten(moved)).drop("_stretches", "_before")


def formatted(
    turns: DataFrame,
    template: Template = CHAT,
    learned: str = "assistant",
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, n_blocks, formatted, loss_mask) of each conversation.

    ``loss_mask`` has the start and end, in code points, of each text of the role ``learned``; marks are never
    under it. Turns are ordered by turn, role and text, a null turn first, so that equal turn numbers and
    repeated rows, which all stay, come in the same order in every run. Null roles and texts count as empty, the
    rows of the null id are one conversation, of an empty frame there is none. A conversation becomes one value,
    so it must fit in a row (2 GB); no task holds more of it than that.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), known(F.col(role_col)).alias("role"), known(F.col(text_col)).alias("text"))
    df = turns.select(F.col(id_col).alias("conv_id"), turn.alias("turn"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    # Turns that open a block, as places from 1, and the blocks between them.
    opens = F.transform(
        "turns", lambda t, i: F.when((i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"]), i + 1)
    )
    df = df.withColumn("opens", F.array_compact(opens))
    block = F.transform("opens", lambda at, i: _block(F.col("turns"), at, F.get(F.col("opens"), i + 1), template))
    df = df.withColumn("blocks", block)

    # Each text with the length of what stands before it since the last one.
    ahead = F.flatten(F.transform("blocks", lambda b, i: _steps(b, i, template)))
    df = df.withColumn("steps", ahead).withColumn("sizes", F.transform("steps", lambda s: s["ahead"] + s["size"]))
    df = with_running_sums(df, "sizes", "ends")
    spans = F.transform("steps", lambda s, i: F.struct(s["role"].alias("role"), s["size"].alias("size"), F.get(F.col("ends"), i).alias("end")))
    mask = F.transform(
        F.filter(spans, lambda s: s["role"] == learned), lambda s: F.struct((s["end"] - s["size"]).alias("start"), s["end"].alias("end"))
    )
    text = F.array_join(F.transform("blocks", lambda b: _written(b, template)), "")
    return df.select("conv_id", F.size("blocks").cast("bigint").alias("n_blocks"), text.alias("formatted"), mask.alias("loss_mask"))


def _block(turns: Column, at: Column, following: Column, template: Template) -> Column:
    own = F.slice(turns, at, F.coalesce(following, F.size(turns) + 1) - at)
    return F.struct(
        F.get(own, F.lit(0))["role"].alias("role"), F.transform(own, lambda t: escaped(t["text"], template)).alias("texts")
    )


def _steps(block: Column, place: Column, template: Template) -> Column:
    opening = F.length(escaped(block["role"], template)) + len(template.start + template.body)
    closing = F.when(place > 0, len(template.end + template.after)).otherwise(0)
    return F.transform(
        block["texts"],
        lambda text, i: F.struct(
            block["role"].alias("role"),
            F.when(i == 0, opening + closing).otherwise(len(template.join)).cast("bigint").alias("ahead"),
            F.length(text).cast("bigint").alias("size"),
        ),
    )


def _written(block: Column, template: Template) -> Column:
    return F.concat(
        F.lit(template.start),
        escaped(block["role"], template),
        F.lit(template.body),
        F.array_join(block["texts"], template.join),
        F.lit(template.end + template.after),
    )


def turns_of(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) read back from a formatted conversation, merged ones apart again."""
    blocks = F.split(text, re.escape(template.end + template.after))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def read(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(template.start) + 1)), re.escape(template.body))
        texts = F.split(F.get(parts, F.lit(1)), re.escape(template.join))
        role = unescaped(F.get(parts, F.lit(0)), template)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t, template).alias("text")))

    return F.flatten(F.transform(blocks, read))


def under_mask(text: Column, mask: Column, template: Template = CHAT) -> Column:
    """The texts under a loss mask, as they were, one after the other."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substr(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), template)),
        "",
    )


def read_back(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks) of formatted conversations.

    Everything is taken from the formatted text and its mask; a conversation without a learned turn has an empty
    text under its mask.
    """
    df = chats.withColumn("turns", turns_of(F.col("formatted"), template))
    df = df.withColumn("loss", under_mask(F.col("formatted"), F.col("loss_mask"), template))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    )
