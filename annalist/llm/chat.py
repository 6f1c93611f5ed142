"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a formatted conversation looks like and which role may follow which.

    ``escapes`` maps each control string to the two characters that stand for it inside texts. The escape character comes
    first in the list, every stand-in begins with it, and no stand-in contains a control string: so an escaped text holds no
    control string, and reading the stand-ins back in reverse order gives the text again.
    """

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
    role_escape: tuple[str, str] = (":", "\\c")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    final: tuple[str, ...] = ("assistant",)
    error: str = field(default="error")


def _escape(text: Column, template: ChatTemplate) -> Column:
    for plain, stand_in in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(stand_in))
    return text


def _unescape(text: Column, template: ChatTemplate) -> Column:
    for plain, stand_in in reversed(template.escapes):
        text = F.replace(text, F.lit(stand_in), F.lit(plain))
    return text


def _escape_role(role: Column, template: ChatTemplate) -> Column:
    plain, stand_in = template.role_escape
    return F.replace(_escape(role, template), F.lit(plain), F.lit(stand_in))


def _unescape_role(role: Column, template: ChatTemplate) -> Column:
    plain, stand_in = template.role_escape
    return _unescape(F.replace(role, F.lit(stand_in), F.lit(plain)), template)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, n_turns, state (where the role machine ends), first_error (1-based turn at which the order broke, null if
    none), valid, segments (array of text and loss flag) and formatted (the segments joined).

    Null roles and texts count as empty; a null role breaks the order. Turns are ordered by turn (null first), then role, then
    text, so ties and repeated rows have one order. Conversations in a wrong order are formatted too, with valid = false. Other
    columns are ignored; an empty table gives an empty result. A conversation is one value of the output, so its turns meet in
    one row; nothing else is gathered.
    """
    said = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    table = F.create_map(*[F.lit(x) for frm, role, to in template.moves for x in (f"{frm}>{role}", to)])
    step = lambda state, t: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), t["role"])), F.lit(template.error))
    walk = F.aggregate(
        "t",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("broke")),
        lambda acc, t: F.struct(
            step(acc["state"], t).alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.when(acc["broke"].isNull() & (step(acc["state"], t) == template.error), acc["seen"] + 1).otherwise(acc["broke"]).alias("broke"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "t",
            lambda t: F.array(
                piece(F.concat(F.lit(template.open), _escape_role(t["role"], template), F.lit(template.after_role)), F.lit(False)),
                piece(_escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                piece(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    return chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), walk.alias("w"), segments.alias("segments")).select(
        "conv_id",
        "n_turns",
        F.col("w.state").alias("state"),
        F.col("w.broke").alias("first_error"),
        F.col("w.state").isin(*template.final).alias("valid"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Add to the rows of :func:`format_chats` what their text says: turns (array of role and text) and loss_text."""
    body = F.expr("left(formatted, greatest(length(formatted) - %d, 0))" % len(template.close))
    close = "\\Q" + template.close + "\\E"
    parts = F.when(F.length("formatted") > 0, F.split(body, close, -1)).otherwise(F.array().cast("array<string>"))
    head = lambda p: F.substring_index(p, template.after_role, 1)
    turns = F.transform(
        parts,
        lambda p: F.struct(
            _unescape_role(F.substr(head(p), F.lit(len(template.open) + 1)), template).alias("role"),
            _unescape(F.substr(p, F.length(head(p)) + F.lit(len(template.after_role) + 1)), template).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescape(s["text"], template)), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
