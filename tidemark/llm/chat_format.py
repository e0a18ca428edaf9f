"""Conversations as training text, and back: a template whose control strings can't come from a text.

A turn is ``### role: text</turn>`` and a new line. The parser splits at every ``### `` and ``</turn>``, so that every second piece
is a turn, takes the role up to the first ``: ``, and takes one backslash out of each broken control string, ``<\\/turn>``, ``##\\# ``
and in roles ``:\\ ``. Text that holds a control string, or one that is broken already, gets one more backslash there, which the
parser takes out again. No control string ends as another begins, so none can arise where a text meets the template. All of it is
column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _SAYS, _CLOSE = "### ", ": ", "</turn>"
#: What is escaped: a control string with any number of backslashes at the given place, as (before, after).
_IN_TEXT = [("<", "/turn>"), ("##", "# ")]
_IN_ROLE = [*_IN_TEXT, (":", " ")]


def _escape(c: Column, broken: list[tuple[str, str]]) -> Column:
    for before, after in broken:
        c = F.regexp_replace(c, rf"{before}(\\*){after}", rf"{before}\\$1{after}")
    return c


def _unescape(c: Column, broken: list[tuple[str, str]]) -> Column:
    for before, after in reversed(broken):
        c = F.regexp_replace(c, rf"{before}\\(\\*){after}", rf"{before}$1{after}")
    return c


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), role, F.lit(_SAYS), text, F.lit(_CLOSE + "\n"))


def _split(formatted: Column) -> Column:
    """What stands between control strings: nothing or a new line, a turn, a new line, a turn and so on."""
    return F.split(formatted, f"{_OPEN}|{_CLOSE}")


def _pieces(formatted: Column) -> Column:
    return F.filter(_split(formatted), lambda _, i: i % 2 == 1)


def _role(piece: Column) -> Column:
    return _unescape(F.substring(piece, F.lit(1), F.instr(piece, _SAYS) - 1), _IN_ROLE)


def _text(piece: Column) -> Column:
    return _unescape(F.substring(piece, F.instr(piece, _SAYS) + len(_SAYS), F.length(piece)), _IN_TEXT)


def parse(formatted: Column) -> Column:
    """The turns of formatted text: array of (role, text). It must be what ``format_chats`` makes."""
    return F.transform(_pieces(formatted), lambda p: F.struct(_role(p).alias("role"), _text(p).alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): conv_id, ``formatted`` and ``loss``, for each turn whether its text is learned.

    Each turn is rendered as it is and parsed again; where that isn't the source, it is rendered with its control strings escaped
    and parsed once more, and a turn that still differed would stop the job. The loss mask has true for turns of role
    ``assistant``; what it covers in the formatted text is read by ``masked``.

    Null roles and texts are empty. Rows go by turn, nulls first; equal turns by role and text; repeated rows are turns of their
    own. A null conv_id is a conversation. Other columns are not read; an empty table gives no rows. A conversation is one value
    of a column, so it must fit one (2 GB, and in memory some three times).
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    same = lambda made: (F.size(_split(F.col(made))) == 3) & (parse(F.col(made))[0] == F.struct("role", "text"))
    plain = rows.withColumn("plain", _turn(F.col("role"), F.col("text")))
    tried = plain.withColumn("made", F.when(same("plain"), F.col("plain")).otherwise(_turn(_escape(F.col("role"), _IN_ROLE), _escape(F.col("text"), _IN_TEXT))))
    sure = F.when(same("made"), F.col("made")).otherwise(F.raise_error(F.lit("a turn isn't read as it was written")).cast("string"))
    turns = tried.select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", sure.alias("made")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["made"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("loss"),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, read from the formatted text and joined without anything between."""
    pieces = F.zip_with(_pieces(formatted), loss, lambda piece, learned: F.when(learned, _text(piece)).otherwise(F.lit("")))
    return F.array_join(pieces, "")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from ``format_chats``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
