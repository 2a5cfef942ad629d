import hashlib
import random

from pyspark.sql import functions as F
from tessera.functions import layout
from tessera.operators import assembly, groups, pii, search
from tessera.sources import configs, sheets


def brute_wrap(text, width):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return [*lines, line] if line or not lines else lines


def brute_pages(counts, per_page):
    pages, page, used = [], 1, 0
    for n in counts:
        if used + n > per_page and used:
            page, used = page + 1, 0
        pages.append(page)
        used += n + 1
    return pages


def test_wrapping_and_pages(spark):
    rnd = random.Random(3)
    texts = [" ".join("x" * rnd.randint(1, 14) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["", "  ", "é" * 30, "a " * 50 + "b" * 25 + " c", "\t tab wide\nline "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    got = {r["id"]: r["w"] for r in df.select("id", layout.wrapped(F.col("text"), 20).alias("w")).collect()}
    assert got[-1] is None
    assert all(got[i] == brute_wrap(t, 20) for i, t in enumerate(texts))
    counts = [[rnd.randint(1, 30) for _ in range(rnd.randint(0, 20))] for _ in range(30)] + [[80, 1, 80], [50], [49, 1], []]
    pages = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "id int, c array<int>").select("id", layout.pages_of(F.col("c")).alias("p"))
    assert {r["id"]: r["p"] for r in pages.collect()} == {i: brute_pages(c, 50) for i, c in enumerate(counts)}


def test_page_query_matches_brute_force(spark):
    from tessera.plans import registry

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry()["page_layout"][0](spark, sf).collect():
        blocks = [brute_wrap(b, 80) for b in texts[r["doc_id"]].split("\n")]
        lines = [x for b in blocks for x in b]
        assert (r["lines"], r["pages"], r["lines_sha256"]) == (len(lines), max(brute_pages(map(len, blocks), 50)), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_sheets(spark):
    texts = {
        1: 'a,"b, c",3\r\n\r\n"x\n""y""",,-1.5e2', 2: "a\tb,c\n1\t2\t3\td", 3: '{"S": [[{"type": "number", "value": 4.5}, {"type": "string", "value": "t"}], []]}', 4: "{not json}", 5: '{"S": 1}', 6: 'a"b,c', 7: '"open,1', 8: '"a"b,1', 9: " \n ", 10: None, 11: "1d,inf, 2,0x10,.5,NaN",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    cells, errors = sheets.parsed_sheets(df, "k")
    got = {}
    for r in cells.orderBy("k", "sheet", "row", "col").collect():
        got.setdefault(r["k"], []).append((r["sheet"], r["row"], r["col"], r["type"][0], r["value"]))
    assert got[1] == [("Sheet1", 0, 0, "s", "a"), ("Sheet1", 0, 1, "s", "b, c"), ("Sheet1", 0, 2, "n", "3"), ("Sheet1", 1, 0, "s", 'x\n"y"'), ("Sheet1", 1, 1, "s", ""), ("Sheet1", 1, 2, "n", "-1.5e2")]
    assert [x[4] for x in got[2]] == ["a", "b,c", "1", "2", "3", "d"]
    assert got[3] == [("S", 0, 0, "n", "4.5"), ("S", 0, 1, "s", "t")]
    assert [x[4] for x in got[4]] == ["{not json}"] and [x[3] for x in got[11]] == ["s", "n", "s", "s", "n", "n"]
    assert {r["k"]: r["error"] for r in errors.collect()} == {5: "quotes", 6: "quotes", 7: "quotes", 8: "quotes", 9: "empty", 10: "empty"}
    semi = sheets.parsed_sheets(spark.createDataFrame([(1, "a;b;c,d")], "k int, text string"), "k", candidates=(",", "\t", ";"))[0]
    assert [r["value"] for r in semi.orderBy("col").collect()] == ["a", "b", "c,d"]


def test_delete_requests(spark):
    entries = spark.createDataFrame([("p", 0, None, False), ("p", 1, "2024-01-01", True), ("p", 2, "2024-01-02", False), ("p", 3, "2024-01-03", False), ("q", 0, "2024-01-02", False), ("r", 0, None, True)], "project string, entry_ord int, d string, archived boolean").withColumn("entry_date", F.to_date("d"))
    asked = [("p", 1, "date", "2024-01-02", None), ("p", 2, "range", "2024-01-01", "2024-01-03"), ("p", 3, "archived", None, None), ("q", 1, "range", "2024-01-01", None), ("q", 2, "melt", None, None), ("r", 1, "all", None, None), ("none", 1, "all", None, None)]
    told, left = search.deleted_by(entries, spark.createDataFrame(asked, "project string, seq int, mode string, since string, until string"))
    assert {(r["project"], r["seq"]): r["deleted"] for r in told.collect()} == {("p", 1): 1, ("p", 2): 1, ("p", 3): 1, ("q", 1): 0, ("q", 2): 0, ("r", 1): 1, ("none", 1): 0}
    assert {(r["project"], r["entry_ord"]) for r in left.collect()} == {("p", 0), ("q", 0)}


def test_places_of_knowledge(spark):
    files = [("skills/d/i18n/de/a.md", "one"), ("skills/d/i18n/en/a.md", "two"), ("skills/d/i18n/de/b.md", " "), ("skills/d/en/b.md", "four"), ("skills/d/i18n/de/z/c.md", "walk"), ("skills/d/a-b/e.md", "later"), ("skills/d/a/e.md", ""), ("skills/d/a/z/e.md", "hidden"), ("skills/own/f.md", "custom"), ("skills/base/es/g.md", "default"), ("prompts/d/a.md", "other kind"), ("skills/d/s/t.md", "slash")]
    asked = [("skill", "d", "de", n) for n in ("a", "b", "c", "e", "f", "none", "s/t")] + [("skill", None, "", "g"), ("skill", "d", "fr", "a")]
    got = assembly.knowledge_files(spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(asked, "kind string, domain string, lang string, name string"))
    found = {(r["name"], r["lang"]): (r["place"], r["content"]) for r in got.collect()}
    # the first file of the walk for e has no text, so nothing is found below it
    assert found == {("a", "de"): (1, "one"), ("b", "de"): (4, "four"), ("c", "de"): (7, "walk"), ("f", "de"): (10, "custom"), ("s/t", "de"): (5, "slash"), ("g", ""): (3, "default"), ("a", "fr"): (2, "two")}


def test_groups_of_agents(spark):
    plan = groups.planned(spark.createDataFrame([("g", ["b", "a", "b"]), ("h", None), ("none", [])], "group string, agents array<string>"), spark.createDataFrame([("projects/h/z/project.json",), ("projects/h/c/project.json",), ("projects/h/deep/x/project.json",), ("projects/g/q/project.json",)], "path string"))
    assert sorted(map(str, plan.collect())) == sorted(map(str, [plan.collect()[0].__class__(**r) for r in [dict(group="g", place=0, agent="b"), dict(group="g", place=1, agent="a"), dict(group="g", place=2, agent="b"), dict(group="h", place=0, agent="c"), dict(group="h", place=1, agent="z"), dict(group="none", place=0, agent=None)]]))
    contexts = spark.createDataFrame([("g", "a", 5, "too long", None), ("g", "b", 3, None, "text"), ("h", "z", 1, None, "")], "group string, agent string, tokens long, error string, text string")
    got = {(r["group"], r["place"]): (r["status"], r["text"]) for r in groups.run_group(plan, contexts).collect()}
    assert got == {("g", 0): ("ok", "text"), ("g", 1): ("stopped", None), ("g", 2): ("ok", "text"), ("h", 0): ("missing", None), ("h", 1): ("ok", ""), ("none", 0): ("empty", None)}
    only = groups.run_group(plan, contexts, ["z", "a"])
    assert {(r["group"], r["place"], r["status"]) for r in only.collect()} == {("g", 0, "missing"), ("g", 1, "stopped"), ("h", 0, "ok"), ("h", 1, "missing"), ("none", 0, "missing"), ("none", 1, "missing")}


def test_configs_that_cannot_be_read(spark):
    good = '{"exchange_rate_clp": 900, "unit": "per_1m_tokens", "providers": {"p": {"m": {"input": 1.5, "output": 2}}}}'
    rows = [("a", good), ("b", "{not json"), ("c", None), ("d", '{"providers": {}}'), ("e", '{"unit": "x"}')]
    found, errors = configs.prices(spark.createDataFrame(rows, "root string, content string"))
    assert [tuple(r) for r in found.collect()] == [("a", "p", "m", 1.5, 2.0, 1_000_000.0, 900.0)]
    assert {r["root"]: r["error"] for r in errors.collect()} == {"b": "invalid", "c": "missing", "d": "no providers", "e": "no providers"}
    rows = [("a", '{"pii_masking": {"min_score": 0.5, "hash_length": 4, "shape_rules": {"at_symbol_bonus": 0.9}}}'), ("b", "["), ("c", None), ("d", '{"pii_masking": {"min_score": 0, "hash_length": 4}}'), ("e", "{}")]
    got = {r["root"]: r for r in configs.policies(spark.createDataFrame(rows, "root string, content string")).collect()}
    own = configs.policy_of(got["a"])
    assert (own.min_score, own.hash_length, own.at_symbol_bonus, own.tag_format, own.shape_weight) == (0.5, 4, 0.9, "", 0.0)
    assert all(got[k]["shipped"] and configs.policy_of(got[k]) == pii.Policy() for k in "bcde")
