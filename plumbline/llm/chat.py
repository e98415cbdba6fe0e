"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

Texts are escaped so that no control string of the template can appear inside one, and the escape can be
undone: `read_back` recovers roles and texts from the formatted string alone.  Only built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings all start with `<|`; `moves` lists for each state the roles it accepts and where they lead."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "begin": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


CHAT = Template()


def escape(text: Column) -> Column:
    """Put a backslash behind every `<` that a `|` or a backslash follows, so `<|` never appears."""
    return F.regexp_replace(text, r"<([\\|])", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([\\|])", "<$1")


def _next_state(state: Column, role: Column, template: Template) -> Column:
    step = F.lit("broken")
    for source, roles in template.moves.items():
        for accepted, target in roles.items():
            step = F.when((state == source) & (role == accepted), F.lit(target)).otherwise(step)
    return step


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conv_id: n_turns, valid, segments array<struct<text, loss>> and formatted.

    Turns stand by turn, then role, then text; null turns come first, a null role or text is empty, a null
    conv_id is a conversation of its own, repeated rows are turns of their own.  A turn order that the state
    machine refuses makes `valid` false; the conversation is formatted all the same.  A conversation is one
    string and so one row; conversations without rows do not exist.  Columns other than conv_id, turn,
    role and text are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    state = F.aggregate("_turns", F.lit(template.first), lambda s, t: _next_state(s, t["role"], template))

    def parts(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(template.start), escape(t["role"]), F.lit(template.middle)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return grouped.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), state.isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("_turns", parts)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns inside a formatted string as array<struct<role, text>>."""
    pieces = F.split(formatted, r"\Q" + template.start + r"\E", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.middle, 1)
        body = F.substring(piece, F.length(role) + len(template.middle) + 1, F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(body, template.end, 1)).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """Unescaped texts under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
