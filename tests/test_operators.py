import io
import zipfile
import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from tessera.functions import text as tx
from tessera.operators import assembly, budget, conversation, focus, jobs, pii, sanitize, search
from tessera.sources import files, office
from tessera.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_repeated_lines(spark):
    rows = [(1, "2024-01-01 10:00:00 a\n2024-01-01 10:00:01 a\n2024-01-01 10:00:02.5 a\nb"), (2, "\n\n\n\nx"), (3, "a\na\nb"), (4, None), (5, ""), (6, "z\nz\nz\nz")]
    got = {r["id"]: (r["text"], r["lines_collapsed"]) for r in sanitize.collapse_repeats(spark.createDataFrame(rows, "id int, text string")).collect()}
    mark = "  [×%d repeticiones idénticas omitidas]"
    assert got == {1: ("2024-01-01 10:00:00 a\n" + mark % 3 + "\nb", 2), 2: ("\n\n\n\nx", 0), 3: ("a\na\nb", 0), 4: (None, 0), 5: ("", 0), 6: ("z\n" + mark % 4, 3)}


def test_sanitize_steps(spark):
    df = spark.createDataFrame([("a\n\n\n\n\nb\n# 1\n// 2\n# 3\n  # 4\n#5\nc",)], "text string")
    r = sanitize.sanitize(df, comments=True).first()
    assert r["text"] == "a\n\n\nb\n  [bloque de 5 líneas de comentarios omitido]\nc"
    assert (r["blank_runs"], r["comment_lines"]) == (1, 5) and r["chars_removed"] < 0


def test_headers_and_paragraphs(spark):
    head = "one\n\ntwo\nthree\n"
    df = spark.createDataFrame([("p", 1, "f1", head + "x"), ("p", 2, "f2", head + "y"), ("q", 3, "f3", head + "z"), ("p", 4, "f4", "one"), ("p", 5, "f5", None)], "scope string, ord int, name string, text string")
    got = {r["ord"]: r["text"] for r in sanitize.dedupe_headers(df, "scope", "ord", "name").collect()}
    assert got == {1: head + "x", 2: "  [encabezado idéntico al de f1 — omitido]\ny", 3: head + "z", 4: "one", 5: None}
    par = spark.createDataFrame([(1, "A  b\r\n\r\nnew"), (2, "A b\n \nA new paragraph.\n\nA\tb"), (3, None), (4, "")], "ord int, text string").withColumn("s", F.lit(1))
    got = {r["ord"]: (r["text"], r["paragraphs_removed"]) for r in sanitize.dedupe_paragraphs(par, ["s"], ["ord"]).collect()}
    assert got == {1: ("A  b\n\nnew", 0), 2: ("A new paragraph.", 2), 3: (None, 0), 4: ("", 0)}


@pytest.mark.parametrize(("token", "score", "masked", "tag"), [
    ("2024-07-30", None, True, "[PII_12656e68]"), ("18.234.567-9", 0.7887, True, "[PII_3437c915]"), ("juan.perez@correo.cl", 0.6122, False, None),
    ("CLI-1001", 0.4867, False, None), ("trace-88213-a", 0.7613, True, None), ("sess_77a1c4", 0.5804, False, None), ("[PII_8901debc]", None, False, None), ("a", None, False, None), ("(18.234.567-9),", None, True, "([PII_3437c915]),"),
])
def test_pii_tokens(spark, token, score, masked, tag):
    r = pii.decide(spark.createDataFrame([(token,)], "token string")).first()
    assert r["masked"] == masked and (score is None or round(r["score"], 4) == score) and (tag is None or r["replacement"] == tag)


def test_pii_texts_keep_white_space(spark):
    df = spark.createDataFrame([(1, "  id:\t18.234.567-9,\n ok  "), (2, None), (3, ""), (4, " \n")], "k int, text string")
    got = {r["k"]: (r["text"], r["n_masked"]) for r in pii.mask_texts(df, "k").collect()}
    assert got == {1: ("  id:\t[PII_3437c915],\n ok  ", 1), 2: (None, 0), 3: ("", 0), 4: (" \n", 0)}


def test_matching(spark):
    df = spark.createDataFrame([("## Artículo 3 — Pluralización",)], "v string")
    r = df.select(tx.like(F.col("v"), F.lit("articulo 3")), tx.like(F.col("v"), F.lit("")), tx.target_matches(F.col("v"), F.lit("=articulo")), tx.all_words(F.col("v"), F.lit("plural  ARTICULO")), tx.all_words(F.col("v"), F.lit("plural x"))).first()
    assert list(r) == [True, True, False, True, False]
    assert one(spark, "src/a/b.go", lambda v: tx.glob_matches(v, "**/*.go")) and not one(spark, "src/a/b.go", lambda v: tx.glob_matches(v, "src/*.go"))


def test_budget(spark):
    assert one(spark, "x", lambda v: budget.limit_message(F.lit(14250), F.lit(8000))).startswith("ERROR\n\nCurrent context (14,250 tokens) exceeds the configured limit (8,000).")
    assert one(spark, "x", lambda v: budget.limit_message(F.lit(1), F.lit(0))) is None
    assert abs(one(spark, "x", lambda v: budget.deviation(F.lit(1000), F.lit(1023))) - 2.3) < 1e-9
    assert one(spark, "x", lambda v: budget.deviation(F.lit(0), F.lit(5))) is None
    usage = spark.createDataFrame([("anthropic", 1000, 1023), ("anthropic", 500, 520), ("openai", 200, 199)], "provider string, local_tokens long, api_tokens long")
    got = {r["provider"]: r["local_tokens"] for r in budget.accuracy(budget.prices(spark), budget.usage_history(usage)).collect()}
    assert got == {"anthropic": 1500, "openai": 200, "google": None}
    rows = budget.costs(spark.createDataFrame([(1000,)], "tokens long"), budget.PRICES).collect()
    assert [(r["provider"], r["usd"]) for r in rows] == [("anthropic", 0.003), ("google", 0.00125), ("openai", 0.005)]


def test_breaker(spark):
    rows = [(1, 11, 10, 5.0, 5.0, "abort", None), (2, 10, 10, 4.9, 5.0, None, True), (3, 11, 10, None, 0.0, None, None), (4, 11, 10, 9.0, 5.0, "abort", False)]
    df = spark.createDataFrame(rows, "id int, run_tokens long, run_limit int, month_usd double, month_limit double, on_exceed string, enabled boolean")
    got = {r["id"]: (r["run_exceeded"], r["month_exceeded"], r["aborted"], r["breaker_message"] is not None) for r in budget.circuit_breaker(df).collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, False), 3: (True, False, False, True), 4: (False, False, False, False)}


def test_focus(spark):
    repo = spark.createDataFrame([
        ("a/x.go", "package x\n\nfunc Total(a int) int {\n\tif a > 0 {\n\t\treturn 1\n\t}\n\treturn 0\n}\n\nfunc B() {}"), ("b/y.py", "import z\n\ndef area(r):\n    return r\n\nprint(1)"), ("db/s.sql", "-- t\nCREATE TABLE IF NOT EXISTS users (\n id int\n);\nselect 1;"),
        ("doc/m.md", "# Órdenes\none\n## Other\ntwo\n# ordenes b\nthree"), ("log.md", "x\n2024-01-02 alpha\nmore\n**2024-01-03** beta"), ("node_modules/q.js", "function Total() {}"),
    ], "path string, content string").where(focus.included(F.col("path")))
    t = lambda *names: spark.createDataFrame([(n,) for n in names], "target string")
    code = {r["target"]: r["content"] for r in focus.code_blocks_of(repo, t("Total", "area")).collect()}
    assert code["Total"].startswith("func Total") and code["Total"].endswith("return 0\n}") and code["area"].rstrip() == "def area(r):\n    return r"
    assert focus.table_definitions(repo, t("users")).first()["content"].startswith("CREATE TABLE IF NOT EXISTS users (\n id int\n);")
    assert sorted(r["content"] for r in focus.matching_sections(repo, t("ordenes"), focus.MARKDOWN_HEADING, "doc-section").collect()) == ["# ordenes b\nthree", "# Órdenes\none"]
    assert focus.dated_entries(repo, t("alpha")).first()["content"] == "2024-01-02 alpha\nmore"
    assert focus.by_path(repo, t("m.md")).first()["source"] == "doc/m.md"
    found = focus.cascade([focus.by_path(repo, t("m.md", "alpha")), focus.excerpts(repo, t("m.md", "alpha", "none"))])
    text = {r["target"]: r["text"] for r in focus.rendered(t("m.md", "alpha", "none"), found).collect()}
    assert text["none"] == "FOCUS:none\n  not found: none" and text["m.md"].startswith("FOCUS:m.md\nFILE:doc/m.md\n# Órdenes")


def test_search(spark):
    df = spark.createDataFrame([("alpha", "one\nALPHA alpha\nx"), ("b", "nothing"), ("c", None)], "name string, text string")
    r = search.keyword_search(df, "Alpha", "name", "text").collect()
    assert len(r) == 1 and r[0]["line"] == 2 and abs(r[0]["score"] - (0.6 + 0.4 * 2 / 7)) < 1e-9
    log = spark.createDataFrame([(1, "## 2024-01-02\na\n\n---\n\nundated\n\n---\n\n## 2024-03-01 x\nb")], "k int, text string")
    entries = search.archive_split(search.entries(log, "k"), F.lit(date(2024, 3, 5)), 30).collect()
    assert [(e["archived"], e["archive_month"]) for e in sorted(entries, key=lambda e: e["entry_ord"])] == [(True, "2024-01"), (False, None), (False, None)]


def test_conversation_scalars(spark):
    assert [one(spark, v, conversation.range_token) for v in ("2-5", "3", "x")] == [(2, 5), (3, 3), (1, 0)]
    assert one(spark, "```go\nx := 1\n```", conversation.unwrapped) == "x := 1"
    assert one(spark, 'say <<{"a": 1}>> done', lambda v: conversation.tool_call(v, "<<", ">>")) == '{"a": 1}'
    assert one(spark, "é" * 200, conversation.truncated_body) == "é" * 150 + "... (truncated)"
    assert one(spark, "SELECT a FROM b WHERE c", conversation.language) == "sql" and one(spark, " ", conversation.language) == ""
    df = spark.createDataFrame([(1, "a\n```py\nx\n```\n```memory\nm\n```\nb\n```\nopen"), (2, "x = 1;\ny = 2;"), (3, "plain prose only"), (4, None)], "id int, text string")
    assert [(r["id"], r["code"]) for r in conversation.code_blocks(df, "id").orderBy("id").collect()] == [(1, "x"), (2, "x = 1;\ny = 2;")]
    assert conversation.strip_code(df).where("id = 1").first()["text"] == "a\nb"


def test_cron(spark):
    assert jobs.parse_cron("5/10 1-3 * * 0,6")["minute"] == [5] and jobs.parse_cron("*/20 * * * *")["minute"] == [0, 20, 40]
    for bad in ("* * * *", "60 * * * *", "* * * * 7", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            jobs.parse_cron(bad)
    df = spark.createDataFrame([(datetime(2024, 9, 13, 8, 30),), (datetime(2024, 9, 14, 8, 30),)], "ts timestamp")
    assert [r[0] for r in df.orderBy("ts").select(jobs.cron_match(F.col("ts"), "30 8 13 * 0")).collect()] == [True, False]
    assert one(spark, "0 9 * * 1", jobs.humanized) == "Weekly on Monday at 09:00" and one(spark, "bad", jobs.humanized) == "bad" and one(spark, "* * * * *", jobs.humanized) == "Every minute"


def test_assembly(spark):
    assert one(spark, "hi {{NAME}} {{X}}", lambda v: assembly.injected(v, F.create_map(F.lit("name"), F.lit("Ana")))) == "hi Ana {{X}}"
    assert one(spark, "{{A}} {{A}} {{B_1}}", assembly.undeclared) == ["A", "B_1"]
    assert one(spark, "- a\n* b\n\n- c", assembly.numbered_bullets) == "1. a\n2. b\n\n1. c"
    r = spark.createDataFrame([(None, "d", ["a", "b"]), ("t", "d", ["a"]), (None, "", ["only"]), (None, None, ["a", "b"])], "e string, d string, ts array<string>").select(assembly.resolved_task(F.col("e"), F.col("d"), F.col("ts")).alias("t")).collect()
    assert [x["t"] for x in r] == ["d", "t", "only", None]


def test_files(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.txt").write_bytes("ñ".encode("latin-1"))
    (tmp_path / "src/vendor/b.txt").write_text("no")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/project.json").write_text('{"name": "x", "tasks": {"b": {}, "a": {"prompt": "q"}}, "unknown": 1, "budget": {"max_tokens": 5}}')
    assert [tuple(r) for r in files.read_files(spark, str(tmp_path / "src")).collect()] == [("a.txt", "ñ")]
    r = files.read_projects(spark, str(tmp_path)).first()
    assert r["task_names"] == ["a", "b"] and r["budget"]["max_tokens"] == 5 and r["budget"]["cache_hint"] is None
    check = lambda p, c: spark.createDataFrame([(p, c)], "p string, c string").select(files.valid_content(F.col("p"), F.col("c"))).first()[0]
    assert check("a.json", '{"a": 1}') and not check("a.json", "{a") and check("a.csv", 'a,"b,c"\nd,e') and not check("a.csv", "a,b\nc") and check("a.md", "{")


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_documents(spark):
    docx = zipped({"word/document.xml": '<w:p><w:r><w:t>Hi &amp; </w:t><w:t xml:space="preserve">you</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p>'})
    xlsx = zipped({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c r="A1" s="2" t="s"><v>0</v></c><c r="B1"><v>3.5</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'})
    pdf = b"%PDF\n1 0 obj\nstream\n" + zlib.compress(b"BT /F1 (Hello ) Tj [(wor) 3 (ld\\))] TJ ET") + b"\nendstream\n"
    df = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pdf", pdf), ("d.docx", b"no zip"), ("e.bin", b"x")], "path string, content binary")
    got = {r["path"]: r["text"] for r in office.document_texts(df).collect()}
    assert got == {"a.docx": "Hi & you\ntwo", "b.xlsx": "## Sheet1\nname\t3.5\tin", "c.pdf": "Hello world)", "d.docx": None, "e.bin": None}


def test_open_runs_wait_for_their_end(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 1, "a")], "k string, at int, line string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in incremental.drained(incremental.closed_runs(stream, "k", ["at"]), spark, "append").collect()] == [("u", "a", 2)]


def test_labels_and_names(spark):
    from tessera.functions import labels

    r = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702)], "i int").select("i", labels.column_letter(F.col("i")).alias("l")).collect()
    assert [x["l"] for x in sorted(r)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, "ééééé", lambda v: labels.truncated_label(v, 6)) == "éé…" and one(spark, "abc", lambda v: labels.truncated_label(v, 6)) == "abc"
    assert one(spark, "x", lambda v: labels.progress_percent(F.lit(1), F.lit(3))) == 33 and one(spark, "x", lambda v: labels.progress_percent(F.lit(1), F.lit(0))) == -1
    assert tuple(one(spark, "9:16", labels.aspect_size)) == (576, 1024) and tuple(one(spark, "odd", labels.aspect_size)) == (768, 768)
    assert one(spark, "claude", labels.is_cloud) and not one(spark, "ollama", labels.is_cloud)
    names = spark.createDataFrame([("gpt-5",), ("gpt-5-mini",), ("claude",)], "name string")
    asked = spark.createDataFrame([("gpt-5",), ("mini",), ("gpt",), ("none",)], "query string")
    assert {r["query"]: r["name"] for r in search.fuzzy_names(asked, names).collect()} == {"gpt-5": "gpt-5", "mini": "gpt-5-mini", "gpt": None, "none": None}
    turns = spark.createDataFrame([(1, 0, "user", "ask\nmore"), (1, 1, "assistant", "# H\n\n|t|\none\ntwo\n---\nthree\nfour"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["summary"] for r in search.fallback_summary(turns).collect()} == {1: "ask\none\ntwo\nthree", 2: ""}
    assert [r["name"] for r in search.like_top(names.withColumn("t", F.lit("x")), "GPT", "name", "t", 1).collect()] == ["gpt-5"]


def test_prose_is_told_by_kind_and_for_files_by_extension(spark):
    from tessera.operators import focus

    rows = [("doc-section", "a.go", True), ("legal-article", "a", True), ("chronological", "a", True), ("bounded-excerpt", "x.py", True), ("file", "a/b.MD", True), ("file", "a.rst", True), ("file", "a.go", False), ("code", "a.md", False), ("json", "a.txt", False)]
    df = spark.createDataFrame(rows, "kind string, path string, want boolean")
    assert df.where(focus.is_prose(F.col("kind"), F.col("path")) != F.col("want")).count() == 0


def test_text_is_written_to_known_extensions_alone(spark):
    from tessera.sources import files

    rows = [("a.txt", True), ("b/c.INI", True), (".env", True), ("x.log", True), ("m.swift", True), ("a.svg", False), ("a.tsv", False), ("a.docx", False), ("a", False)]
    df = spark.createDataFrame(rows, "path string, want boolean")
    assert df.where(files.writable(F.col("path")) != F.col("want")).count() == 0


def test_texts_are_masked_in_their_rows(spark):
    from tessera.operators import pii

    rows = [(1, "mail ana.perez99@mail.example now,\n  id 12.345.678-9!  "), (1, "plain words ONLY HERE"), (2, None), (3, ""), (4, " [PII_0a1b2c3d] ")]
    out = sorted((r["k"], r["text"] or "", r["n_scanned"], r["n_masked"], r["text"] is None) for r in pii.mask_texts(spark.createDataFrame(rows, "k int, text string"), "k").collect())
    by = {(k, n): (t, m) for k, t, n, m, _ in out}
    masked, n = by[1, 5]
    assert n == 2 and masked.startswith("mail [PII_") and masked.endswith("]!  ") and ",\n  id [PII_" not in masked.split("[PII_")[0] and "ana" not in masked and "345" not in masked
    assert by[1, 4] == ("plain words ONLY HERE", 0) and by[4, 1] == (" [PII_0a1b2c3d] ", 0)
    assert [x for x in out if x[0] == 2] == [(2, "", 0, 0, True)] and [x for x in out if x[0] == 3] == [(3, "", 0, 0, False)]
