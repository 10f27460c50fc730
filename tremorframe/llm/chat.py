"""Chat formatting: a template, a state machine over roles, and loss flags for segments.

``Template`` declares the marks, which roles are learned from, and which role may follow which. A
conversation's turns become segments (text, loss): marks have no loss, a turn's text has its
role's flag. Texts and roles are escaped so that no control string appears in them: the escape
character becomes ``\\e``, the control strings' opening ``<|`` becomes ``\\l`` and, in roles, a newline ``\\n``. That is
undone exactly by ``read_back``. Everything is built-in DataFrame functions.

Turns are in the order of (turn, role, text), nulls first. Edge cases: a null text or role is empty; a null conv_id
is a conversation of its own; repeated rows are repeated turns; roles that the machine doesn't know, or that come out of order, are
formatted and the conversation is marked not ``valid``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``follows`` maps a state to the roles that may come next (each role is also the state after it)."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    control: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    ends: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


CHAT = Template()
SEGMENT = "struct<text string, loss boolean>"


def escaped(text: Column, t: Template) -> Column:
    one = F.replace(text, F.lit(t.escape), F.lit(t.escape + "e"))
    return F.replace(one, F.lit(t.control), F.lit(t.escape + "l"))


def unescaped(text: Column, t: Template) -> Column:
    one = F.replace(text, F.lit(t.escape + "l"), F.lit(t.control))
    return F.replace(one, F.lit(t.escape + "e"), F.lit(t.escape))


def valid(roles: Column, t: Template) -> Column:
    """Runs the machine over an array of roles: it ends in an allowed state, having met no role out of turn."""
    moves = F.create_map(*[F.lit(x) for s, after in t.follows.items() for r in after for x in (f"{s}\n{r}", r)])
    last = F.aggregate(roles, F.lit(t.start), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("")))
    return last.isin(*t.ends)


def formatted(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """(conv_id, segments, formatted, valid): the segments of each conversation and their text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role, text).alias("row"))
    # One conversation is one formatted text, so its turns meet in one row anyway.
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def segments(r: Column) -> Column:
        head = F.concat(F.lit(t.opening), F.replace(escaped(r["role"], t), F.lit("\n"), F.lit(t.escape + "n")), F.lit(t.after_role))
        part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escaped(r["text"], t), r["role"].isin(*t.loss_roles)), part(F.lit(t.closing + t.after_turn), F.lit(False)))

    done = talks.select("conv_id", F.flatten(F.transform("rows", segments)).alias("segments"), valid(F.transform("rows", lambda r: r["role"]), t).alias("valid"))
    return done.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def spans(segments: Column) -> Column:
    """(start, length) in code points of the segments under the loss mask."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        n = F.char_length(s["text"])
        here = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, zero, step)["spans"]


def read_back(text: Column, t: Template = CHAT) -> Column:
    """Array of (role, text) of the turns in a formatted text, unescaped."""
    parts = F.split(text, F.lit(_quoted(t.opening)), -1)
    turns = F.slice(parts, F.lit(2), F.size(parts))

    def turn(x: Column) -> Column:
        role = F.split_part(x, F.lit(t.after_role), F.lit(1))
        body = F.substring(x, F.char_length(role) + len(t.after_role) + 1, F.char_length(x) - F.char_length(role) - len(t.after_role + t.closing + t.after_turn))
        return F.struct(unescaped(F.replace(role, F.lit(t.escape + "n"), F.lit("\n")), t).alias("role"), unescaped(body, t).alias("text"))

    return F.transform(turns, turn)


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in mark)


def digests(talks: DataFrame, t: Template = CHAT) -> DataFrame:
    """What the output of ``formatted`` holds, read back from its text and its loss spans."""
    turns = read_back(F.col("formatted"), t)
    under = F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), t))
    rows = talks.select("conv_id", "formatted", "valid", turns.alias("turns"), spans(F.col("segments")).alias("spans"))
    rows = rows.select("*", F.array_join(under, "").alias("learned"))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
