import hashlib
import itertools
import random
import re
import zlib

import pytest
from tessera.llm import conversation_repair as R


def cheapest(codes: list[str], limit: int) -> tuple[int, str]:
    """All edits of up to `limit` inserted rows, tried one by one."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < limit:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserted + 1)
        if i < len(codes):
            initial, fault = codes[i]
            go(i + 1, roles, cost + 2, audit + "D", inserted)
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                go(i + 1, roles + initial, cost + more, audit + "K", inserted)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return best


def test_search_finds_the_cheapest_audit():
    rnd = random.Random(3)
    for _ in range(300):
        codes = [rnd.choice("suuaa?") + rnd.choice("-----bdt") for _ in range(rnd.randint(0, 5))]
        assert R.repair_block("".join(codes)) == cheapest(codes, 3)


def test_blocks_in_a_row_give_what_one_block_gives():
    rnd = random.Random(4)
    for _ in range(60):
        codes = [rnd.choice("suuaa?") + rnd.choice("-----bdt") for _ in range(rnd.randint(2, 40))]
        size = rnd.randint(1, 9)
        parts = ["".join(codes[i : i + size]) for i in range(0, len(codes), size)]
        options = [{(s, t): best for s in range(4) for t in range(4) if (best := R.repair_block(p, s, (t,)))} for p in parts]
        cost, states = R.join_blocks(options)
        audit = "".join(o[s][1] for o, s in zip(options, states, strict=True))
        assert (cost, audit) == R.repair_block("".join(codes))


def test_long_conversations_are_searched_in_time():
    rnd = random.Random(5)
    codes = "".join(rnd.choice("suuaa?") + rnd.choice("-----bdt") for _ in range(R.BLOCK_ROWS))
    assert len(R.repair_block(codes)[1]) >= R.BLOCK_ROWS


def digest(rows, codes, audit, entry=0):
    left = []
    for at, _, letter, role in R.steps_of(codes, audit, entry):
        if letter == "I":
            left.append(f"{role}:")
        elif letter != "D":
            left.append(f"{role or rows[at][1]}:{rows[at][2]}")
    return hashlib.sha256("\n".join(left).encode()).hexdigest()


def report(rows):
    """The report of a conversation's rows (turn, role, text), in order."""
    seen, codes = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "?") + fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = R.repair_block("".join(codes))
    return (gaps, *(sum(c[1] == f for c in codes) for f in "bdt"), illegal, cost, audit, digest(rows, "".join(codes), audit))


def damaged(rows):
    """Planted faults, row by row; rows: (conv_id, turn, role, text)."""
    space = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def wanted(original, rows):
    by = {conv: [] for conv, *_ in original}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return sorted(((conv, *report(sorted(own, key=order))) for conv, own in by.items()), key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_damaged_table_matches_brute_force(spark):
    from tessera.llm import queries

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    original = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, "/root/testdata/sf0.01")
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == wanted(original, damaged(original))


ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be good."), (1, None, None, None),
    (2, 3, "assistant", "no end"), (2, 9, "assistant", "No end."), (2, 9, "assistant", "Ñandú 🙂 wörld."), (3, None, "tool", "x."), (3, None, "", ""),
    (None, 1, "user", "Without id."), (None, 2, "assistant", " \n"), (None, None, "user", None), (4, 1, "user", "a\nb."), (4, 2, "user", "b:c."), (5, 1, "assistant", "." * 100_000), (5, 2, "user", "ok"),
]


@pytest.mark.parametrize("rows", [1024, 2])
def test_odd_conversations(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    # one conversation of many rows, most of them equal
    long = [(7, i // 3, "ua"[i % 2] + "x", f"text {i % 5}.") for i in range(200)] + [(8, 0, "user", "Same.")] * 150
    long = [(c, t, {"u": "user", "a": "assistant"}.get(r[0], r), x) for c, t, r, x in long]
    rows = ODD + long
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("*", "'x' as at", "'y' as block", "1 as audit", "2 as kind")
    for frame, own in ((df, rows), (R.damage(df), damaged(rows))):
        given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
        _, merged = R.repair(frame)
        assert sorted((tuple(r) for r in merged.select(*COLUMNS).collect()), key=str) == wanted(given, given)


def test_edited_rows_are_a_dialogue(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    steps, _ = R.repair(df)
    by = {}
    for r in steps.where("edit != 'D'").orderBy("at", "place").collect():
        by[r["conv_id"]] = by.get(r["conv_id"], "") + r["role"][0]
    assert all(re.fullmatch("(s?(ua)+)?", roles) for roles in by.values())
    assert steps.where("edit != 'I'").count() == len(ODD)


def test_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("-", 1, "user", "Hi."), (None, 1, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    _, merged = R.repair(df)
    assert {r["conv_id"]: r["audit"] for r in merged.collect()} == {"a": "D", "-": "D", None: "D"}
    _, none = R.repair(df.where("turn > 5"))
    assert none.count() == 0
