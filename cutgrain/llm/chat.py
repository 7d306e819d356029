"""Chat formatting with a finite-state machine over roles; DataFrame functions only.

A template is data: marks around a turn, which roles are under the loss, and the machine's transitions. Control
strings inside roles and texts are escaped reversibly: a backslash is doubled and "<|" becomes "<\\|", so neither mark
can occur in what is said, and parse() gives back every role and text.

A conversation is one output cell, so its turns meet in one row; they are gathered with a map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state; a role that has no entry makes the conversation invalid
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    accept: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _role(x: Column) -> Column:
    """A role also has to keep to its line."""
    return F.replace(escape(x), F.lit("\n"), F.lit("\\|n"))


def _unrole(x: Column) -> Column:
    # "\|n" stands for a line's end only where its backslash isn't itself escaped
    return unescape(F.regexp_replace(x, r"(?s)((?:^|[^\\])(?:\\\\)*)\\\|n", "$1\n"))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, valid, final_state, segments array<struct<text, loss>>).

    Turns are taken by turn number (nulls last; equal numbers by role, then text; repeated rows are repeated turns).
    A null role or text is empty. Rows with a null conv_id form one conversation. Conversations that the machine
    rejects are formatted all the same, with valid false. Concatenated segments are the training text; exactly the
    texts of loss roles carry the loss. An empty table gives no rows.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    convs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def moved(state: Column, turn: Column) -> Column:
        ways = [F.when((state == name) & (turn["role"] == role), F.lit(to)) for name, by in template.machine.items() for role, to in by.items()]
        return F.coalesce(*ways, F.lit("invalid"))

    def parts(turn: Column) -> Column:
        loss = turn["role"].isin(*template.loss_roles)
        seg = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
        return F.array(seg(F.concat(F.lit(template.begin), _role(turn["role"]), F.lit("\n")), F.lit(False)), seg(escape(turn["text"]), loss), seg(F.lit(template.end), F.lit(False)))

    state = F.aggregate("turns", F.lit(template.start), moved)
    return convs.select("conv_id", state.alias("final_state"), F.flatten(F.transform("turns", parts)).alias("segments")).select("conv_id", F.col("final_state").isin(*template.accept).alias("valid"), "final_state", "segments")


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse(formatted: Column, template: Template = CHATML) -> Column:
    """Formatted text -> array<struct<role, text>>, exactly what was formatted."""
    begin, end = template.begin, template.end
    blocks = F.slice(F.split(formatted, "\\Q" + begin + "\\E", -1), F.lit(2), F.lit(2**31 - 2))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        n = F.char_length(role)
        return F.struct(_unrole(role).alias("role"), unescape(F.substr(x, n + 2, F.char_length(x) - n - 1 - F.lit(len(end)))).alias("text"))

    return F.transform(blocks, turn)


def digest(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What can be read back from format_chats()'s output, as digests: one row a conversation, of any length, the null id's
    among them. Null texts and roles were formatted as empty ones; no rows give none; other columns are dropped."""
    whole = formatted.select("conv_id", "valid", text_of(F.col("segments")).alias("whole"), loss_text(F.col("segments")).alias("loss"))
    read = whole.select("*", parse(F.col("whole"), template).alias("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("whole").cast("long").alias("formatted_chars"),
        "valid",
    )
