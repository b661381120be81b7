"""Conversations as one training string with a loss mask, by Spark expressions alone.

The format, for each run of turns of one role::

    <|role|>text<|more|>text<|end|>

``<|`` never stands inside a role or text: ``<`` is written as ``<\\`` wherever a text
has ``<`` followed by any number of backslashes and then ``|``, that is, one backslash is put
after such a ``<``, and reading back takes one away.  So every string a text may hold,
this format's own marks and those of other formats included, comes back unchanged
and cannot end a turn.  Role names are percent-encoded where they hold ``%``, ``|`` or ``<`` or
are one of the two reserved names, which then begin with an encoded letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import pick

MORE = "<|more|>"
END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _named(role: Column) -> Column:
    """A role's name as it stands in a mark: never a reserved name, and without ``|`` and ``<``."""
    plain = F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("<"), F.lit("%3C"))
    return F.when(role == "end", F.lit("%65nd")).when(role == "more", F.lit("%6Dore")).otherwise(plain)


def _role(name: Column) -> Column:
    """The role that a name stands for; a percent sign of its own is always encoded, so no other text reads as a code."""
    for code, char in (("%65", "e"), ("%6D", "m"), ("%3C", "<"), ("%7C", "|"), ("%25", "%")):
        name = F.replace(name, F.lit(code), F.lit(char))
    return name


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments) per conversation of ``turns`` (conv_id, turn, role, text).

    Turns are sorted by turn, then role, then text (null first), so that ties and
    repeated rows have one order; every row is kept.  Adjacent turns of one role merge
    into one block, their texts set apart by a mark.  ``segments`` is the loss mask: an
    array of (text, loss) whose texts concatenate to ``formatted``; loss is true for the
    texts of role ``trained`` and false for all marks and other texts.  Null text or
    role: empty.  A null conv_id is a conversation of its own, as by GROUP BY.  Empty
    table: no rows.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text")
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    role_at = lambda i: F.try_element_at(F.col("turns"), i)["role"]  # noqa: E731  (from 1; null past the end)
    mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    # A turn opens a block, or is joined to the block of the turn before; it closes the block
    # if the next turn has another role.  Linear in the number of turns.
    pieces = F.transform(
        F.col("turns"),
        lambda t, i: F.array(
            mark(F.when((i > 0) & (role_at(F.greatest(i, F.lit(1))) == t["role"]), F.lit(MORE)).otherwise(F.concat(F.lit("<|"), _named(t["role"]), F.lit("|>")))),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == F.lit(trained)).alias("loss")),
            mark(F.when(F.coalesce(role_at(i + 2) == t["role"], F.lit(False)), F.lit("")).otherwise(F.lit(END))),
        ),
    )
    segments = gathered.select("conv_id", F.filter(F.flatten(pieces), lambda x: x["text"] != "").alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments")


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) read back from ``format_chats`` output alone."""
    role_of = lambda b: F.regexp_extract(b, r"^<\|([^|]*)\|>", 1)
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.length(role_of(b)) + 5), r"<\|more\|>", -1),
                lambda x: F.struct(_role(role_of(b)).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )
    masked = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"]))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
