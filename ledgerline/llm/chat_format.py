"""Chat formatting: a declarative template and a finite-state machine over roles turn conversations into segments with loss flags.

Everything is column functions. A conversation is one row of the result, so its turns meet in one row; conversations are
dealt by their id and none is read by more than one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import picked


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Control strings of a format, and which role may follow which.

    A control string begins with an opening and ends with a closing character that occur nowhere else in control strings. Then no two
    overlap, neither with each other nor across the border of a text. ``other`` marks roles without an entry in ``turns``, with their
    name before ``named``. ``order``: the roles that may follow each state, a state being the last role, '' at the start.
    """

    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[ANS]", "</s>", loss=True)})
    other: Turn = Turn("[ROLE]", "[/ROLE]")
    named: str = "[TEXT]"
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        strings = self.controls()
        outer = {s[0] for s in strings} | {s[-1] for s in strings}
        apart = not {s[0] for s in strings} & {s[-1] for s in strings}
        befores = [self.begin, self.named, *[t.before for t in (*self.turns.values(), self.other)]]
        if not apart or any(len(s) < 3 or outer & {*s[1:-1]} or "\\" in s for s in strings) or len({*befores}) < len(befores):
            raise ValueError("control strings need an opening and a closing character of their own, and roles different marks")
        if {*befores} & {t.after for t in (*self.turns.values(), self.other)}:
            raise ValueError("what ends a turn must not begin one")

    def controls(self) -> list[str]:
        turns = (*self.turns.values(), self.other)
        return sorted({self.begin, self.named, *[t.before for t in turns], *[t.after for t in turns]})

    def pattern(self, escaped: bool = False) -> str:
        """Group 1: opening character, 2: backslashes but the first, 3: rest of a control string."""
        opening = "".join(sorted({re.escape(s[0]) for s in self.controls()}))
        rests = "|".join(sorted({re.escape(s[1:]) for s in self.controls()}))
        return rf"([{opening}]){r'\\' if escaped else ''}(\\*)({rests})"


DEFAULT = Template()


def escaped(text: Column, template: Template) -> Column:
    """One backslash more after the opening character of each control string, with backslashes there or without: no control string is left."""
    return F.regexp_replace(text, template.pattern(), r"$1\\$2$3")


def unescaped(text: Column, template: Template) -> Column:
    """One backslash less: the inverse of ``escaped``."""
    return F.regexp_replace(text, template.pattern(escaped=True), "$1$2$3")


def _by_role(role: Column, template: Template, known, other) -> Column:
    """The value of ``known`` for each declared role, else ``other``."""
    out = None
    for name, turn in template.turns.items():
        out = F.when(role == name, known(turn)) if out is None else out.when(role == name, known(turn))
    return other if out is None else out.otherwise(other)


def first_out_of_order(roles: Column, template: Template = DEFAULT) -> Column:
    """0-based place of the first turn that the machine refuses, or the number of turns where it ends in no accepted state; else null.

    After a refusal the machine's state is the refused role, but only the first one is told.
    """
    steps = F.array(*[F.lit(f"{state}>{role}") for state, nexts in template.order.items() for role in nexts])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        allowed = F.array_contains(steps, F.concat(acc["state"], F.lit(">"), role))
        return F.struct(role.alias("state"), (acc["n"] + 1).alias("n"), F.when(acc["bad"].isNotNull() | allowed, acc["bad"]).otherwise(acc["n"]).alias("bad"))

    ended = lambda acc: F.coalesce(acc["bad"], F.when(~acc["state"].isin(*template.ends), acc["n"]))
    return F.aggregate(roles, start, step, ended)


def formatted(conversations: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, segments (array of text and loss), valid, bad_turn.

    The segments' texts one after another are the formatted conversation. Only texts of roles with ``loss`` are under the loss; marks
    never are. Conversations out of order are formatted too, with ``valid`` false and the place of the first fault in ``bad_turn``.
    Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have one order and all of them stay. A null role
    or text counts as empty; rows without an id are one conversation. An empty table gives no rows; extra columns are ignored.
    """
    rows = picked(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def segments(t: Column) -> Column:
        text = escaped(t["text"], template)

        def of(turn: Turn) -> Column:
            if turn.loss:
                return F.array(segment(F.lit(turn.before), False), segment(text, True), segment(F.lit(turn.after), False))
            return F.array(segment(F.concat(F.lit(turn.before), text, F.lit(turn.after)), False))

        o = template.other
        named = F.concat(F.lit(o.before), escaped(t["role"], template), F.lit(template.named), text, F.lit(o.after))
        return _by_role(t["role"], template, of, F.array(segment(named, False)))

    bad = first_out_of_order(F.transform("turns", lambda t: t["role"]), template)
    out = F.concat(F.array(segment(F.lit(template.begin), False)), F.flatten(F.transform("turns", segments)))
    return gathered.select("conv_id", out.alias("segments"), bad.alias("bad_turn")).select("conv_id", "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def joined(segments: Column | str = "segments") -> Column:
    """The formatted conversation as one text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_of(text: Column, template: Template = DEFAULT) -> Column:
    """Roles and texts, as they were, read from a formatted conversation."""
    ends = "|".join(sorted({re.escape(t.after) for t in (*template.turns.values(), template.other)}))
    pieces = F.split(F.substring(text, len(template.begin) + 1, 2**31 - 1), ends, -1)
    o = template.other

    def read(piece: Column) -> Column:
        after = lambda mark: F.substring(piece, len(mark) + 1, 2**31 - 1)
        role = F.substring_index(after(o.before), template.named, 1)
        body = F.substring(piece, F.length(role) + len(o.before) + len(template.named) + 1, F.length(piece))
        out = F.when(piece.startswith(o.before), F.struct(unescaped(role, template).alias("role"), unescaped(body, template).alias("text")))
        for name, turn in template.turns.items():
            out = out.when(piece.startswith(turn.before), F.struct(F.lit(name).alias("role"), unescaped(after(turn.before), template).alias("text")))
        return out

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def read_back(chats: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per formatted conversation: conv_id, turns (role and text), loss_text, formatted_chars, valid, bad_turn; all from the segments alone."""
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    texts = chats.select("conv_id", joined().alias("formatted"), under.alias("loss_text"), "valid", "bad_turn")
    return texts.select("conv_id", turns_of(F.col("formatted"), template).alias("turns"), "loss_text", F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
