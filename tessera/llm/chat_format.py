"""Chat formatting: a state machine over roles checks turn order; a declarative template makes the text and its loss mask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START = "start"


def _dialogue() -> dict[str, tuple[str, ...]]:
    return {_START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class ChatTemplate:
    """What a conversation looks like as text, and what a model learns from it.

    A turn is `opening` role newline text `closing`. Control strings start with
    `mark`; inside roles and texts the escape character parts it, so that
    neither can end a turn. after: roles that may follow each state (the role
    before, or "start"); last: roles a conversation may end with.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    mark: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    after: dict[str, tuple[str, ...]] = field(default_factory=_dialogue)
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not (self.opening.startswith(self.mark) and self.closing.startswith(self.mark)) or self.escape in self.mark or len(self.mark) < 2:
            raise ValueError("control strings have to start with mark, which has two characters or more and no escape")


def escaped(text: Column, t: ChatTemplate) -> Column:
    e = F.lit(t.escape)
    return F.replace(F.replace(text, e, F.lit(t.escape * 2)), F.lit(t.mark), F.lit(t.mark[0] + t.escape + t.mark[1:]))


def unescaped(text: Column, t: ChatTemplate) -> Column:
    """Doubled escapes are cut out first, so that the rest holds single ones only."""
    parts = F.split(text, "\\Q" + t.escape * 2 + "\\E", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(t.escape), F.lit(""))), t.escape)


def _escaped_role(role: Column, t: ChatTemplate) -> Column:
    """Roles end at a newline, so theirs is written as escape and n."""
    return F.replace(escaped(role, t), F.lit("\n"), F.lit(t.escape + "n"))


def _unescaped_role(role: Column, t: ChatTemplate) -> Column:
    parts = F.split(role, "\\Q" + t.escape * 2 + "\\E", -1)
    plain = lambda p: F.replace(F.replace(p, F.lit(t.escape + "n"), F.lit("\n")), F.lit(t.escape), F.lit(""))
    return F.array_join(F.transform(parts, plain), t.escape)


def _fault(roles: Column, t: ChatTemplate) -> Column:
    """Index of the first turn out of order; the number of turns if the end is wrong; null if all is in order."""
    steps = [F.lit(f"{len(a)}:{a}>{b}") for a, bs in t.after.items() for b in bs]
    known = F.array(*steps)

    def step(state: Column, role: Column) -> Column:
        before = F.when(state["at"] == 0, F.lit(_START)).otherwise(state["role"])
        taken = F.array_contains(known, F.concat(F.length(before).cast("string"), F.lit(":"), before, F.lit(">"), role))
        fault = F.coalesce(state["fault"], F.when(~taken, state["at"]))
        return F.struct((state["at"] + 1).alias("at"), role.alias("role"), fault.alias("fault"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("role"), F.lit(None).cast("int").alias("fault"))
    return F.aggregate(roles, start, step, lambda s: F.coalesce(s["fault"], F.when(~s["role"].isin(*t.last), s["at"])))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, segments, fault and valid.

    segments: array of (text, loss) whose texts, joined, are `formatted`; loss
    is true on the texts of template.loss_roles and nowhere else. fault: index
    of the first turn out of order, null if none; such conversations are
    formatted too, and `valid` tells them apart. Turns stand in order of turn
    number (null first), ties by role and text; repeated rows are repeated
    turns. Null roles and texts are empty; a null id is a conversation of its
    own; an empty table gives no rows; other columns are not read. A
    conversation becomes one row, so its turns have to fit in one.
    """
    t = template or ChatTemplate()
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pieces(x: Column) -> Column:
        before = F.concat(F.lit(t.opening), _escaped_role(x["role"], t), F.lit("\n"))
        return F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")), F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")))

    out = chats.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", pieces)).alias("segments"), _fault(F.transform("turns", lambda x: x["role"]), t).alias("fault"))
    return out.select(conv_col, "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "fault", F.col("fault").isNull().alias("valid"))


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation, array of (role, text): the inverse of format_chats."""
    t = template or ChatTemplate()
    turns = F.filter(F.split(formatted, "\\Q" + t.closing + "\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(t.opening) + 1))
        cut = F.instr(body, "\n")
        return F.struct(_unescaped_role(F.substr(body, F.lit(1), cut - 1), t).alias("role"), unescaped(F.substr(body, cut + 1), t).alias("text"))

    return F.transform(turns, turn)


def chat_digests(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Digests read back from the output of format_chats: of all turns, and of what lies under the loss mask."""
    t = template or ChatTemplate()
    rows = format_chats(turns, t, conv_col).withColumn("parsed", parse_chat(F.col("formatted"), t))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    rows = rows.withColumn("loss_text", loss)
    whole = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        conv_col,
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
