"""Chat formatting with a declarative template, by DataFrame functions only.

A finite-state machine over roles validates the order of turns; each turn becomes three text segments (opening,
body, closing) with a loss flag; their concatenation is the formatted conversation. Control strings inside a body
are escaped with a backslash behind their first character, and backslashes are doubled, so that a formatted text
splits at its control strings into exactly its turns and reads back to them. A free role stands on a line of its own, so its
line breaks are written as a backslash and ``n``. No pattern recurses, so texts and roles may be of any length.

Defined results: rows are ordered by turn, then role and text, so ties and repeated rows have one order; a null
text is empty, a null role is the empty role, a null turn comes first, a null conv_id is a conversation of its own;
conversations whose roles break the order are formatted like the others and marked ``valid = false``; an empty table
gives none; further columns are ignored. One conversation is one output text, so it is held by one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Turn(NamedTuple):
    role: str
    opening: str
    closing: str
    loss: bool


class Template(NamedTuple):
    turns: tuple[Turn, ...]
    #: of any other role: its name stands between the opening and the break
    other: Turn
    #: the machine: state -> role -> state; no entry: the order is broken
    states: dict[str, dict[str, str]]
    start: str
    accepting: tuple[str, ...]


#: A public instruction format: system, user and assistant turns; the assistant's text alone is trained on.
INSTRUCT = Template(
    turns=(Turn("system", "<<SYS>>\n", "\n<</SYS>>\n\n", False), Turn("user", "<s>[INST] ", " [/INST]", False), Turn("assistant", " ", " </s>", True)),
    other=Turn("", "<|turn|>", " <|/turn|>", False),
    states={"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    start="start",
    accepting=("asked", "answered"),
)
BREAK = "\n"
#: The first character of each control string and what follows it.
CONTROLS = r"<(?=/?s>|<SYS>>|</SYS>>|\|/?turn\|>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROLS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes part the role first, so what is left of backslashes stands for a break or marks a control string."""
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit(BREAK)))), "\\")


def _role_case(template: Template, role: Column, value, other) -> Column:
    out = None
    for t in template.turns:
        out = F.when(role == t.role, value(t)) if out is None else out.when(role == t.role, value(t))
    return out.otherwise(other)


def segments_of(template: Template, turn: Column) -> Column:
    """The three segments of a turn as structs of text and loss flag."""
    role, text = turn["role"], turn["text"]
    opening = _role_case(template, role, lambda t: F.lit(t.opening), F.concat(F.lit(template.other.opening), escape_role(role), F.lit(BREAK)))
    closing = _role_case(template, role, lambda t: F.lit(t.closing), F.lit(template.other.closing))
    loss = _role_case(template, role, lambda t: F.lit(t.loss), F.lit(template.other.loss))
    part = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escape(text), loss), part(closing, F.lit(False)))


def final_state(template: Template, turns: Column) -> Column:
    """The machine's state behind the last turn, ``broken`` once a role has no transition."""

    def step(state: Column, turn: Column) -> Column:
        out = None
        for at, moves in template.states.items():
            for role, to in moves.items():
                hit = (state == at) & (turn["role"] == role)
                out = F.when(hit, F.lit(to)) if out is None else out.when(hit, F.lit(to))
        return out.otherwise(F.lit("broken"))

    return F.aggregate(turns, F.lit(template.start), step)


def format_chat(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, roles' final state, valid, segments and formatted text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return (
        turns.withColumn("segments", F.flatten(F.transform("_turns", lambda t: segments_of(template, t))))
        .withColumn("state", final_state(template, F.col("_turns")))
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            "state",
            F.col("state").isin(*template.accepting).alias("valid"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def parse_chat(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text as array<struct<role, text>>: the inverse of ``format_chat``."""
    quote = lambda s: "".join("\\" + c if c in r"\.[]{}()*+-?^$|<>/" else c for c in s)
    kinds = (*template.turns, template.other)
    pieces = F.regexp_extract_all(formatted, F.lit("(?s)(.*?(?:" + "|".join(quote(t.closing) for t in kinds) + "))"), F.lit(1))

    def turn(piece: Column) -> Column:
        out = None
        for t in kinds:
            body = lambda skip: F.substring(piece, F.lit(skip) + 1, F.length(piece) - F.lit(skip) - F.lit(len(t.closing)))  # noqa: E731, B023
            if t is template.other:
                named = F.substring_index(F.substring(piece, F.lit(len(t.opening) + 1), F.length(piece)), BREAK, 1)
                made = F.struct(unescape_role(named).alias("role"), unescape(body(F.length(named) + len(t.opening) + 1)).alias("text"))
            else:
                made = F.struct(F.lit(t.role).alias("role"), unescape(body(len(t.opening))).alias("text"))
            out = F.when(piece.endswith(t.closing), made) if out is None else out.when(piece.endswith(t.closing), made)
        return out

    return F.transform(pieces, turn)


def digests(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and digests read back from the output: turns from the formatted text, loss from the segments."""
    read = chats.select("conv_id", "state", "valid", "segments", "formatted", parse_chat(F.col("formatted"), template).alias("_read"))
    lines = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )
