import random
from functools import cache

from pyspark.sql import functions as F
from tessera.operators import budget, conversation, diff, focus, gate, intents


def one(spark, expr, *values):
    cols = [F.lit(v).alias(f"c{i}") for i, v in enumerate(values)]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()["x"]


def test_focus_blocks_round_trip(spark):
    texts = ["before\nFOCUS:a\nx\ny\nFOCUS:b\n\nFOCUS:c\nz\n", "FOCUS:a\n", "no mark", "", "FOCUS:a\nk"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", gate.focus_blocks(F.col("t")).alias("s"))
    rows = rows.select("t", "s", gate.joined_focus(F.col("s")).alias("back")).collect()
    assert [r["back"] for r in rows] == [*texts, None]
    assert [b["name"] for b in rows[0]["s"]["blocks"]] == ["a", "b", "c"] and rows[0]["s"]["preamble"] == "before\n"


def test_headers_of_later_blocks_go(spark):
    head = "// one\n// two\n\n// three\n"
    df = spark.createDataFrame([(f"FOCUS:a\n{head}x\nFOCUS:b\n{head}y\nFOCUS:c\nother\nFOCUS:d\nother",), (None,), ("plain",)], "focus string")
    got = gate.dedupe_blocks(df, "focus").collect()
    assert got[0]["headers_removed"] == 1 and got[0]["focus"] == f"FOCUS:a\n{head}x\nFOCUS:b\n  [encabezado idéntico al de a — omitido]\ny\nFOCUS:c\nother\nFOCUS:d\nother"
    assert (got[1]["focus"], got[1]["headers_removed"], got[2]["focus"]) == (None, 0, "plain")


CONTEXT = "id long, head string, focus string, memory string, tail string, token_limit long, run_limit long, month_usd double, month_limit double, on_exceed string, enabled boolean"


def test_gates_in_order_and_report(spark, tmp_path):
    rows = [
        (1, "h", "FOCUS:a\nmail bob@x1y2.com", "m\nm\nm\nm", None, 0, 0, 0.0, 0.0, None, None),
        (2, "h", "x" * 400, None, None, 50, 50, 0.0, 0.0, "abort", None),
        (3, "h", "x" * 400, None, None, 50, 50, 0.0, 0.0, "warn", None),
    ]
    df = spark.createDataFrame(rows, CONTEXT)
    out = gate.gated(df, masking=True)
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["error"] is None and got[1]["lines_removed"] == 3 and got[1]["text"].startswith("h")
    assert got[2]["error"].startswith("Circuit breaker") and got[2]["text"] is None
    assert got[3]["error"].startswith("ERROR") and got[3]["breaker_message"]
    report = gate.report(out, "id", budget.PRICES)
    gate.write_reports(report, "id", str(tmp_path / "reports"))
    gate.write_reports(report.where("id = 2"), "id", str(tmp_path / "reports"))
    read = {p.name: "".join(f.read_text() for f in p.glob("part-*")) for p in (tmp_path / "reports").glob("id=*")}
    assert set(read) == {"id=1", "id=2", "id=3"}
    assert "## Files" in read["id=1"] and "## Circuit Breaker" not in read["id=1"] and "## Circuit Breaker" in read["id=2"]
    assert "| **TOTAL** | **" in read["id=1"]


def test_memo_is_keyed_by_configuration(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    empty = spark.createDataFrame([], "content_key string, output string")
    work = lambda d: d.withColumn("output", F.upper("text"))
    out, new = gate.memoized(df, empty, work, "one")
    assert new.count() == 3 and sorted((r["id"], r["output"], r["hit"]) for r in out.collect()) == [(1, "A", False), (2, "B", False), (3, "A", False), (4, "", False)]
    again, more = gate.memoized(df, new, work, "one")
    assert more.count() == 0 and again.where("hit").count() == 4
    assert gate.memoized(df, new, work, "two")[0].where("hit").count() == 0


def lcs(a, b):
    @cache
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_line_diff_matches_brute_force(spark):
    rnd = random.Random(3)
    pairs = [("a\nb\nc", "a\nx\nc\nd"), ("same", "same"), (None, "new"), ("", "")]
    for _ in range(60):
        pairs.append(tuple("\n".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(2)))
    got = diff.line_diff(spark.createDataFrame(pairs, "old string, new string")).collect()
    assert (got[0]["lines_added"], got[0]["lines_removed"], got[0]["preview"]) == (2, 1, "- b\n+ x\n+ d\n")
    assert got[1]["preview"] == "(no changes)" and not got[1]["changed"]
    for (old, new), r in zip(pairs, got, strict=True):
        a, b = (old or "").split("\n"), (new or "").split("\n")
        n = lcs(tuple(a), tuple(b))
        assert (r["lines_removed"], r["lines_added"]) == (len(a) - n, len(b) - n)
        shown = r["preview"].splitlines() if r["changed"] else []
        assert not [x for x in a if a.count(x) < sum(s == "- " + x for s in shown)]


def test_large_diffs_are_bounded(spark):
    long = "\n".join(map(str, range(1500)))
    df = spark.createDataFrame([(long, long + "\nx"), ("\n".join("ab" * 200), "\n".join("cd" * 200))], "old string, new string")
    big, many = diff.line_diff(df).collect()
    assert big["lines_added"] is None and "1500 -> 1501 lines" in big["preview"]
    assert many["lines_added"] == 400 and many["preview"].count("\n") == diff.SHOWN + 1


def test_intents(spark):
    save = lambda t: tuple(one(spark, intents.save_intent(F.lit(t))))
    assert save("crea la carpeta docs y genera un resumen.md") == (["docs"], ["resumen.md"])
    assert save("create c:/temp/a.txt and explain b.txt") == ([], ["c:/temp/a.txt"])
    assert save("what is in main.go?") == ([], [])
    edit = one(spark, intents.edit_intent(F.lit("fix a.go and look at b.go and update 'x/c.py' d.py")))
    assert edit["asked"] and edit["files"] == ["a.go", "x/c.py", "d.py"]
    assert tuple(one(spark, intents.edit_intent(F.lit(None).cast("string")))) == (False, [])
    how = lambda t: tuple(one(spark, intents.save_modifiers(F.lit(t))))
    assert how("agrega esto al final del archivo") == (True, None)
    assert how("don't overwrite it, do not replace") == (False, False)
    assert how("overwrite it") == (False, True) and how("hola") == (False, None)


def test_paths_and_labels(spark):
    folders = spark.createDataFrame([("r/a/src",), ("r/b/src",), ("r/docs",), ("r/docs",)], "path string")
    ask = ["src/x.go", "docs/y.md", "new/z.md", "p/q/../w.md", "/etc//a/./b", "f.txt", "D:\\k.txt", "", None]
    got = {r["requested"]: r for r in intents.resolved_paths(spark.createDataFrame([(x,) for x in ask], "requested string"), folders, root="r").collect()}
    assert [got[x]["resolved"] for x in ask] == [None, "r/docs/y.md", "r/new/z.md", "r/p/w.md", "/etc/a/b", "r/f.txt", None, None, None]
    assert [got[x]["error"] for x in ask] == ["ambiguous", None, None, None, None, None, "windows path", "empty", "empty"]
    assert one(spark, F.array(*[intents.target_kind(F.lit(t)) for t in ("a/", "*.go", "a.b")])) == ["dir", "glob", "file"]
    built = F.array(F.lit("read"), F.lit("write"))
    assert one(spark, intents.allowed_tools(F.array(F.lit("write"), F.lit("none")), built)) == ["write"]
    assert one(spark, intents.allowed_tools(F.array().cast("array<string>"), built)) == ["read", "write"]
    line = one(spark, intents.markdown_line(F.lit("## a **b** c")))
    assert line["level"] == 2 and [tuple(r) for r in line["runs"]] == [("a ", False), ("b", True), (" c", False)]


def test_all_resolvers(spark):
    repo = spark.createDataFrame([
        ("a/x.go", "package x\n// the return of type Total is odd\n"), ("b/y.go", "func (r *R) Total() int {\n\treturn 1\n}\n"), ("c/z.py", "def areas(r):\n    return r\nend"),
        ("conf.json", '{"a": {"b.c": 1, "d": [7, {"e": 2}]}, "s": "x"}'), ("db/t.sql", "create table users (\n id int\n);"),
        ("doc/m.md", "# Intro\none\ntwo blue words here"), ("law.txt", "Artículo 3 Bis\ntext"), ("log.md", "2024-01-02 alpha\nmore"), ("bad.json", "{"),
    ], "path string, content string")
    want = {
        "m.md": "file", "db/": "dir-index", "conf.json#a.d": "json-node", "users": "sql", "Total": "code-symbol", "rea": "code-symbol", "intro": "doc-section",
        "articulo 3": "legal-article", "alpha": "chronological", "*.sql": "file", "words two": "bounded-excerpt",
    }
    missing = ["=REA", "conf.json#a.d.0", "conf.json#a.b", "bad.json#a", "=words two"]
    targets = spark.createDataFrame([(t,) for t in (*want, *missing)], "target string")
    found = focus.resolved(repo, targets)
    rows = {r["target"]: r for r in found.collect()}
    assert {t: r["kind"] for t, r in rows.items()} == want
    assert rows["Total"]["source"] == "b/y.go" and rows["rea"]["content"] == "def areas(r):\n    return r"
    assert rows["conf.json#a.d"]["content"] == '[7,{"e":2}]'
    text = {r["target"]: (r["text"], r["n_sources"]) for r in focus.rendered_by_kind(targets, found).collect()}
    assert text["m.md"] == ("FOCUS:m.md\n# Intro\none\ntwo blue words here\n", 1) and text["db/"][0] == "FOCUS:db/\n  db(1): t.sql\n"
    assert text["=REA"] == ("FOCUS:=REA\n  not found: =REA\n", 0)


def test_fences_without_a_tag_get_one(spark):
    go, py = "package main\nfunc main() {\n\tfmt.Println(1)\n}", "def f(self):\n    import os\n    print(1)"
    text = f"a\n```\n{go}\n```\nb\n```text\n{py}\n```\n```  \n{py}\n ``` \n```\n\n```\n```\n{go}"
    tag = lambda code: one(spark, conversation.language(F.lit(code)))
    assert tag(go) and tag(py) and tag(go) != tag(py)
    want = f"a\n```{tag(go)}\n{go}\n```\nb\n```text\n{py}\n```\n```{tag(py)}\n{py}\n ``` \n```\n\n```\n```\n{go}"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no fence")], "id long, text string")
    got = {r["id"]: r["text"] for r in conversation.tagged_fences(df).collect()}
    assert got == {1: want, 2: None, 3: "", 4: "no fence"}
