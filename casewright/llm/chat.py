"""Conversations as training text, DataFrame functions only.

A declarative :class:`Template` says how the turns of each role are marked,
which texts bear loss, and which role may follow which state: a finite-state
machine that every conversation is folded through.  A conversation becomes
segments (text, loss) whose texts in a row are the formatted conversation; loss
flags belong to whole segments, so that no character offsets have to be kept.

Control strings inside texts are escaped: a backslash goes between their first
character and the rest, and where backslashes stand there already, one more.
That is undone by taking one away, so that any text comes back as it was.

A conversation is the unit of the output and has to fit into one row; nothing
larger is ever collected.

Defined cases: a null text is empty, a null role is the role ''; turns are in
order of turn, then role, then text, nulls first, so that ties and repeated
rows are turns of their own in that order; rows with a null conversation id are
one conversation; roles that the template doesn't know get a marker with their
name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class Turn:
    """What stands before and after the texts of a role, and whether they bear loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers, and the machine over roles: ``moves[state][role]`` is the next state."""

    roles: dict[str, Turn]
    #: Of roles without an entry: before the role's name, between name and text, after the text.
    named: tuple[str, str, str]
    #: Ends each turn and nothing else; every ``after`` ends with it.
    end: str
    #: Every string that texts must not hold as it is.
    control: tuple[str, ...]
    moves: dict[str, dict[str, str]]
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    firsts: str = field(init=False, default="")

    def __post_init__(self) -> None:
        firsts = "".join(sorted({c[0] for c in self.control}))
        object.__setattr__(self, "firsts", firsts)
        if any(x in firsts + "\\" for c in self.control for x in c[1:]) or "\\" in firsts:
            raise ValueError("a control string holds its kind's first character or a backslash after its start")
        marks = [*(x for t in self.roles.values() for x in (t.before, t.after)), *self.named]
        if self.end not in self.control or any(not any(c in m for c in self.control) for m in marks) or not all(a.endswith(self.end) for a in [self.named[2], *(t.after for t in self.roles.values())]):
            raise ValueError("every marker holds a control string, and the end of a turn is one")
        befores = [*(t.before for t in self.roles.values()), self.named[0]]
        if any(a is not b and a.startswith(b) for a in befores for b in befores):
            raise ValueError("two roles begin alike")

    def _held(self, slashes: str) -> str:
        rest = "|".join(re.escape(c[1:]) for c in sorted(self.control, key=len, reverse=True))
        return f"([{re.escape(self.firsts)}]){slashes}({rest})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._held(r"(\\*)"), r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._held(r"\\(\\*)"), r"$1$2$3")


INSTRUCT = Template(
    roles={"system": Turn("<s>[SYS] ", " [/SYS]</s>"), "user": Turn("<s>[INST] ", " [/INST]</s>"), "assistant": Turn("<s>[OUT] ", "</s>", loss=True)},
    named=("<s>[ROLE] ", " [/ROLE] ", "</s>"),
    end="</s>",
    control=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]"),
    moves={"start": {"system": "instructed", "user": "asked"}, "instructed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
)


def _machine(template: Template, turns: Column) -> Column:
    """struct(state, n, bad): the last state, the number of turns, and which was the first that no move allows."""
    moves = [F.lit(x) for state, by in template.moves.items() for role, to in by.items() for x in (f"{state}\n{role}", to)]
    table = F.create_map(*moves)
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(s["state"], F.lit("\n"), t["role"])), F.lit(ERROR))
        bad = F.coalesce(s["bad"], F.when(to == ERROR, s["n"]))
        return F.struct(to.alias("state"), (s["n"] + 1).alias("n"), bad.alias("bad"))

    return F.aggregate(turns, begin, step)


def _segments(template: Template, turn: Column) -> Column:
    """The segments of one turn: marker, text, marker."""
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = template.escaped(turn["text"])
    before, between, after = map(F.lit, template.named)
    out = F.array(segment(F.concat(before, template.escaped(turn["role"]), between), False), segment(text, False), segment(after, False))
    for role, t in template.roles.items():
        out = F.when(turn["role"] == role, F.array(segment(F.lit(t.before), False), segment(text, t.loss), segment(F.lit(t.after), False))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segments, valid, first_bad): one row for each conversation.

    ``first_bad`` is the first turn, from 0, that the machine has no move for;
    a conversation is valid if there is none and its last state accepts.
    Invalid ones are formatted too: the caller decides.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("end", _machine(template, F.col("turns")))
    segments = F.flatten(F.transform("turns", lambda t: _segments(template, t)))
    return convs.select("conv_id", segments.alias("segments"), (F.col("end.bad").isNull() & F.col("end.state").isin(*template.accept)).alias("valid"), F.col("end.bad").alias("first_bad"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_texts(template: Template, segments: Column) -> Column:
    """The texts under the loss mask, as they were before formatting."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))


def parsed(template: Template, text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    ended = lambda after: after[: -len(template.end)]

    def turn(piece: Column) -> Column:
        before, between, after = template.named
        named = F.substr(piece, F.lit(len(before) + 1))
        cut = F.position(F.lit(between), named)
        role, said = F.substr(named, F.lit(1), cut - 1), F.substr(named, cut + len(between), F.char_length(named) - cut - len(between) + 1 - len(ended(after)))
        out = F.struct(template.unescaped(role).alias("role"), template.unescaped(said).alias("text"))
        for name, t in template.roles.items():
            own = F.substr(piece, F.lit(len(t.before) + 1), F.char_length(piece) - len(t.before) - len(ended(t.after)))
            out = F.when(F.startswith(piece, F.lit(t.before)), F.struct(F.lit(name).alias("role"), template.unescaped(own).alias("text"))).otherwise(out)
        return out

    pieces = F.split(text, re.escape(template.end), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def digests(convs: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What a formatted table says when it is read back: counts and digests of turns and of the texts under loss."""
    read = convs.select("conv_id", "valid", formatted(F.col("segments")).alias("whole"), F.array_join(loss_texts(template, F.col("segments")), "").alias("loss"))
    read = read.select("conv_id", "valid", "loss", F.char_length("whole").alias("formatted_chars"), parsed(template, F.col("whole")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"), "valid",
    )
