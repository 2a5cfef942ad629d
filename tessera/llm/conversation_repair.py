"""Conversation structure repair by depth-first branch-and-bound.

Rows of a conversation are kept, given another role, deleted, or new ones are
put in, until their roles are those of a dialogue. A search node is (rows done,
role before); an explicit stack walks the edits in depth. A prefix goes no
further if its cost and the lower bound of the rest exceed the incumbent's, or
if the node's dominance table has a better (cost, audit). What is left when the
stack is empty is proved to be the cheapest audit, the ASCII-least of several.

Conversations of any length are sorted by ranges and cut into blocks of
BLOCK_ROWS. The cheapest edits of a block between any two roles stand for its
rows: the same search then puts blocks together. Equal costs of a block never go
with audits of which one begins the other (the longer one would have more
inserted rows), so the best of the parts is the best of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ship, spark_of

#: Rows of a block at most; a power of two.
BLOCK_ROWS = 1024
#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, and the role before. A dialogue may end in START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an edit gives in a state: no edit makes a system row.
_GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_BLANKS = " \t\n\x0b\x0c\r"

Move = tuple[int, str, int]


def row_moves(code: str, state: int) -> list[Move]:
    """(cost, letter, next state) of the edits that use up a row. code: its role's initial (`?` if it fits nowhere) and its fault (b, d, t or -)."""
    moves = [(DELETE, "D", state)]
    if code[1] not in "bd":
        more = TRUNCATED if code[1] == "t" else 0
        if (state, code[0]) in _AFTER:
            moves.append((KEEP + more, "K", _AFTER[state, code[0]]))
        moves.append((REROLE + more, "R", _GIVEN[state][1]))
    return moves


def lower_bounds(layers: int, moves: Callable[[int, int], list[Move]], goals: tuple[int, ...]) -> list[list[float]]:
    """By layer and state, what the rest costs at least: costs alone, whatever the audit."""
    bounds = [[0.0 if s in goals else float("inf") for s in range(4)]]
    for i in range(layers, -1, -1):
        if i < layers:
            bounds.append([min((cost + bounds[-1][t] for cost, _, t in moves(i, s)), default=float("inf")) for s in range(4)])
        own = bounds[-1]
        for _ in range(2):  # a user and an assistant row may be put in before it
            own[:] = [min(own[s], INSERT + own[_GIVEN[s][1]]) for s in range(4)]
    return bounds[::-1]


def search(layers: int, moves: Callable[[int, int], list[Move]], entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from entry before layer 0 to one of goals after the last; None if nothing does."""
    rest = lower_bounds(layers, moves, goals)
    if rest[0][entry] == float("inf"):
        return None
    incumbent: tuple[int, str] | None = None
    dominant: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if dominant[i, state] < (cost, audit):
            continue  # a better prefix has come to this node since
        if incumbent and (cost + rest[i][state], audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        if i == layers and state in goals:
            incumbent = min(incumbent or (cost, audit), (cost, audit))
            continue
        steps = [(c, a, i + 1, t) for c, a, t in moves(i, state)] if i < layers else []
        steps.append((INSERT, "I", i, _GIVEN[state][1]))
        branches = []
        for c, a, j, t in steps:
            prefix, bound = (cost + c, audit + a), cost + c + rest[j][t]
            if bound < float("inf") and prefix < dominant.get((j, t), (float("inf"), "")) and (not incumbent or bound <= incumbent[0]):
                dominant[j, t] = prefix
                branches.append((bound, prefix[1], j, t, prefix[0]))
        branches.sort(reverse=True)  # the most promising is popped first
        stack.extend((j, t, c, a) for _, a, j, t, c in branches)
    return incumbent


def repair_block(codes: str, entry: int = START, goals: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The cheapest (cost, audit) of rows given by their codes, two characters a row."""
    rows = [codes[i : i + 2] for i in range(0, len(codes), 2)]
    known = {(code, s): row_moves(code, s) for code in set(rows) for s in range(4)}
    return search(len(rows), lambda i, s: known[rows[i], s], entry, goals)


def join_blocks(options: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cheapest cost of blocks in a row, and (entry, goal) of each; options: their cheapest (cost, audit) by (entry, goal)."""

    def moves(i: int, s: int) -> list[Move]:
        return [(*options[i][s, t], t) for t in range(4) if (s, t) in options[i]]

    cost, audit = search(len(options), moves, START, ENDS)
    way, states = [], {START: ""}
    for own in options:  # walk the audit back: prefixes of it alone go on
        reached = {}
        for s, done in states.items():
            for t in range(4):
                if (s, t) in own and audit.startswith(whole := done + own[s, t][1]):
                    reached.setdefault(t, (whole, s))
        way.append(reached)
        states = {t: whole for t, (whole, _) in reached.items()}
    end = next(t for t, whole in states.items() if whole == audit and t in ENDS)
    back = []
    for reached in reversed(way):
        back.append((reached[end][1], end))
        end = reached[end][1]
    return cost, back[::-1]


def steps_of(codes: str, audit: str, entry: int) -> list[tuple[int, int, str, str | None]]:
    """(index of the row, place before it, letter, given role): what an audit does; inserted rows stand before a row, or after the last."""
    out, at, place, state = [], 0, 0, entry
    for letter in audit:
        role = None
        if letter in "RI":
            role, state = _GIVEN[state]
        elif letter == "K":
            state = _AFTER[state, codes[2 * at]]
        out.append((at, place, letter, role))
        at, place = (at, place + 1) if letter == "I" else (at + 1, 0)
    return out


def illegal_pairs(codes: str) -> int:
    """Neighbours whose initials are not those of system and user, user and assistant, assistant and user."""
    initials = codes[::2]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damage(turns: DataFrame, rate: int = 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns (conv_id, turn, role, text) with planted faults: by crc32(`conv_id:turn`) % rate, 0 drops a row, 1 empties it, 2 takes its stops, 3 repeats it, 4 gives it to the user.

    Null roles and texts, and null ids and turns inside the key, are one space.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn, role, text = (F.col(c) for c in (conv_col, turn_col, role_col, text_col))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % rate
    rows = turns.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def diagnose(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at, block, code of turns (conv_id, turn, role, text), as a written table.

    at numbers all rows in order of conversation and turn (nulls first), ties by
    role and text; rows of a conversation are neighbours. code: initial of the
    role and first fault of the row. Null roles and texts are one space.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    # rows that are equal so far stay together, so that equal rows are neighbours
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    bare = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    first = F.left("role", F.lit(1))
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("?")
    rows = rows.withColumns({"at": F.monotonically_increasing_id(), "h1": F.xxhash64("conv_id", "role", "text"), "h2": F.xxhash64(F.lit(1), "conv_id", "role", "text"), "initial": initial, "fault": fault})
    return materialize(rows, "repair-rows")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, at, initial, fault of the rows of diagnose(), duplicates told from the others; no texts."""
    slim = rows.select("conv_id", "at", "initial", "fault", "h1", "h2")
    earliest = slim.groupBy("h1", "h2").agg(F.min("at").alias("earliest"))
    seen = slim.join(earliest.hint("merge"), ["h1", "h2"])
    fault = F.when((F.col("fault") != "b") & (F.col("at") > F.col("earliest")), "d").otherwise(F.col("fault"))
    return seen.select("conv_id", "at", "initial", fault.alias("fault"))


def plan_repairs(codes: DataFrame) -> DataFrame:
    """conv_id, block, at (of the first row), codes, entry, cost, audit, illegal: the cheapest edits of every block of conversations, as a written table."""
    ship(spark_of(codes))
    cell = F.struct("at", F.concat("initial", "fault").alias("code"))
    blocks = codes.groupBy("conv_id", F.shiftright("at", BLOCK_ROWS.bit_length() - 1).alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    blocks = blocks.select("conv_id", "block", F.col("cells")[0]["at"].alias("at"), F.array_join(F.transform("cells", lambda c: c["code"]), "").alias("codes"))
    blocks = materialize(blocks, "repair-blocks")
    spans = blocks.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = spans.where("first < last").select(F.col("conv_id").alias("id"), "first")
    blocks = blocks.join(long.hint("merge"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")

    @F.pandas_udf("cost long, audit string, illegal long")
    def alone(codes: pd.Series) -> pd.DataFrame:
        found = [(*repair_block(c), illegal_pairs(c)) for c in codes]
        return pd.DataFrame(found, columns=["cost", "audit", "illegal"])

    @F.pandas_udf("array<struct<entry:int,goal:int,cost:long,audit:string>>")
    def ways(codes: pd.Series) -> pd.Series:
        return pd.Series([[(s, t, *best) for s in range(4) for t in range(4) if (best := repair_block(c, s, (t,)))] for c in codes])

    @F.pandas_udf("array<struct<block:long,at:long,codes:string,entry:int,cost:long,audit:string,illegal:long>>")
    def together(parts: pd.Series) -> pd.Series:
        out = []
        for own in parts:
            own = sorted(own, key=lambda p: p["block"])
            options = [{(w["entry"], w["goal"]): (int(w["cost"]), w["audit"]) for w in p["ways"]} for p in own]
            _, states = join_blocks(options)
            before = [None, *(p["codes"][-2] for p in own[:-1])]
            seams = [b is not None and b + p["codes"][0] not in ("su", "ua", "au") for b, p in zip(before, own, strict=True)]
            out.append([(p["block"], p["at"], p["codes"], s, *o[s, t], illegal_pairs(p["codes"]) + seam) for p, o, (s, t), seam in zip(own, options, states, seams, strict=True)])
        return pd.Series(out)

    short = blocks.where("first is null").withColumn("best", alone("codes"))
    short = short.select("conv_id", "block", "at", "codes", F.lit(START).alias("entry"), "best.cost", "best.audit", "best.illegal")
    parts = blocks.where("first is not null").withColumn("ways", ways("codes"))
    joined = parts.groupBy("conv_id").agg(F.collect_list(F.struct("block", "at", "codes", "ways")).alias("parts"))
    joined = joined.select("conv_id", F.inline(together("parts")))
    return materialize(short.unionByName(joined), "repair-plans")


def edited(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, at, place, edit, turn, role, text: all rows of the conversations as the plans leave them, deleted ones (edit D) and inserted ones (I) too, in order of at and place."""
    ship(spark_of(rows))

    @F.pandas_udf("array<struct<index:int,place:int,edit:string,given:string>>")
    def told(codes: pd.Series, audits: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([steps_of(c, a, e) for c, a, e in zip(codes, audits, entries, strict=True)])

    steps = plans.select("conv_id", "at", F.inline(told("codes", "audit", "entry")))
    steps = steps.select("conv_id", (F.col("at") + F.col("index")).alias("at"), "place", "edit", "given")
    texts = rows.select(F.col("at").alias("row"), "turn", "role", "text")
    # an inserted row stands before the row of its number, and has none of its own
    own = F.when(F.col("edit") != "I", F.col("at"))
    out = steps.withColumn("row", own).where("row is not null").join(texts.hint("merge"), "row")
    out = out.select("conv_id", "at", "place", "edit", "turn", F.coalesce("given", "role").alias("role"), "text")
    new = steps.where("edit = 'I'").select("conv_id", "at", "place", "edit", F.lit(None).cast("long").alias("turn"), F.col("given").alias("role"), F.lit("").alias("text"))
    # rows and what stands before them: inserted rows have the lower places
    return out.unionByName(new)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames come in order of conversation; a text is held once, its digest grows."""
    key, digest, out = None, None, []
    for frame in frames:
        for k, role, text in zip(frame["key"], frame["role"], frame["text"], strict=True):
            if k != key:
                if digest:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["key", "sha"])
        out = []
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited rows, report) of turns (conv_id, turn, role, text).

    edited: see edited(). report, one row per conversation: gaps (missing turn
    numbers), blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours out of order), cost and audit of the cheapest repair, and
    repaired_sha256, the digest of `role:text` of what it leaves, joined by line
    ends. A row is blank without a visible character, a duplicate if role and
    text stood earlier in the conversation, truncated if its last visible
    character is none of .!?; blank rows and duplicates have to go. Roles count
    by their first letter, s, u or a; others, and empty ones, cannot be kept.
    Rows stand in order of turn, nulls first, ties by role and text. Null roles
    and texts are one space; rows with a null id are one conversation; an empty
    table gives no rows; other columns are not read. The digest of a
    conversation is made in one task, as it has to be, in bounded memory.
    """
    own = turns.select("conv_id", "turn", "role", "text")
    rows = diagnose(own)
    codes = materialize(coded(rows), "repair-codes")
    plans = plan_repairs(codes)
    steps = materialize(edited(rows, plans), "repair-edits")
    id_type = dict(own.dtypes)["conv_id"]
    key = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    left = steps.where("edit != 'D'").select(key.alias("key"), "at", "place", "role", "text")
    left = left.repartition("key").sortWithinPartitions("key", "at", "place").select("key", "role", "text")
    shas = left.mapInPandas(_digests, "key string, sha string")
    shas = shas.select(F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(id_type).alias("conv_id"), "sha")
    per_turn = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    count = lambda f: F.count(F.when(F.col("fault") == f, 1))
    parts = [
        own.select("conv_id").distinct(),
        per_turn.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")),
        codes.groupBy("conv_id").agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated")),
        plans.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"]), "").alias("audit")),
        shas,
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    merged = union.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return steps, merged
