from pyspark.sql import functions as F
from tessera.operators import assembly, memory, sanitize, writes
from tessera.sources.files import valid_content


def test_json_has_to_be_one_whole_value(spark):
    rows = [('{"a": 1}', True), ("[1, 2]", True), ("7", True), (' {"a": 1} \n', True), ("", False), ('{"a": 1} rest', False), ("1, 2", False), ('1, "b": 2', False), ("1],[2", False), ('1}, "c": {', False), ('{"a": ', False)]
    df = spark.createDataFrame(rows, "content string, ok boolean")
    got = df.select("content", "ok", valid_content(F.lit("x.json"), F.col("content")).alias("found")).collect()
    assert [r["content"] for r in got if r["ok"] != r["found"]] == []


def test_saves_by_mode(spark):
    files = spark.createDataFrame([("a.md", "one"), ("b.md", "two"), ("c.md", "three"), ("d.md", "four")], "path string, content string")
    asked = [("a.md", "x", "create"), ("b.md", "x", "overwrite"), ("c.md", "x", "append"), ("d.md", " x ", "prepend"), ("e.md", "new", "create"), ("f.bin", "x", "create"), (None, "x", "create"), ("g.md", None, "create")]
    outcome = writes.saved(files, spark.createDataFrame(asked, "path string, content string, mode string"))
    status = {r["path"]: r["status"] for r in outcome.collect()}
    assert status == {"a.md": "exists", "b.md": "written", "c.md": "written", "d.md": "written", "e.md": "written", "f.bin": "unsupported", None: "unsupported", "g.md": "invalid"}
    now = {r["path"]: r["content"] for r in writes.after(files, outcome).collect()}
    assert (now["a.md"], now["b.md"], now["c.md"], now["d.md"], now["e.md"]) == ("one", "x", "threex", "x\n\n---\n\nfour", "new")


def test_several_saves_of_a_path_are_not_lost_silently(spark):
    import pytest

    files = spark.createDataFrame([("a.md", "old")], "path string, content string")
    asked = spark.createDataFrame([("a.md", "x", "append"), ("a.md", "y", "append")], "path string, content string, mode string")
    with pytest.raises(Exception, match="several saves of a.md"):
        writes.after(files, writes.saved(files, asked)).collect()


def test_edits_of_a_path_follow_their_order(spark):
    files = spark.createDataFrame([("a.md", "old"), ("b.json", "[1]"), ("z.md", "as it was"), ("y.md", "same same")], "path string, content string")
    asked = [
        ("a.md", 2, "append", "y", None), ("a.md", 1, "append", "x", None), ("a.md", 3, "create", "no", None), ("a.md", 4, "patch", "-", "x"), ("a.md", 5, "patch", "-", "x"),
        ("n.md", 1, "create", "one", None), ("n.md", 2, "create", "two", None), ("n.md", 3, "prepend", " top ", None), ("n.md", 4, "overwrite", None, None),
        ("b.json", 1, "append", ",", None), ("b.json", 2, "overwrite", '{"a": 1}', None), ("b.json", 3, "patch", "]", "1"), ("y.md", 1, "patch", "x", "same"), ("y.md", 2, "patch", "x", ""), ("y.md", 3, "patch", "x", None), ("y.md", 4, "melt", "x", None),
        ("c.exe", 1, "create", "x", None), (None, 1, "create", "x", None),
    ]
    outcome, now = writes.edited(files, spark.createDataFrame(asked, "path string, seq int, mode string, content string, old string"))
    status = {}
    for r in outcome.orderBy("seq").collect():
        status.setdefault(r["path"], []).append(r["status"])
    assert status == {
        "a.md": ["written", "written", "exists", "written", "unmatched"], "n.md": ["written", "exists", "written", "invalid"], "b.json": ["invalid", "written", "invalid"],
        "y.md": ["ambiguous", "unmatched", "unmatched", "unknown"], "c.exe": ["unsupported"], None: ["unsupported"],
    }
    assert {r["path"]: r["content"] for r in now.collect()} == {"a.md": "old-y", "n.md": "top\n\n---\n\none", "b.json": '{"a": 1}', "z.md": "as it was", "y.md": "same same"}
    assert now.count() == 5


def test_deletes_name_each_file_once_and_report_patterns_without_any(spark):
    files = spark.createDataFrame([("r/a.csv",), ("r/b.csv",), ("s/a.csv",)], "path string")
    gone, report = writes.glob_deletes(files, ["r/*.csv", "r/a.*", "none.md"])
    assert sorted(r["path"] for r in gone.collect()) == ["r/a.csv", "r/b.csv"]
    assert {r["pattern"]: r["files"] for r in report.collect()} == {"r/*.csv": 2, "r/a.*": 1, "none.md": 0}


def test_recent_memory_is_cut_by_the_newest(spark):
    rows = [("p", f"e{i}", i, i == 9) for i in range(10)] + [("q", None, 1, False)]
    df = spark.createDataFrame(rows, "project string, content string, created_at long, archived boolean")
    got = {r["project"]: r["text"] for r in memory.recent(df, 3).collect()}
    assert got == {"p": "e8\n\n---\n\ne7\n\n---\n\ne6", "q": ""}
    assert memory.recent(df.limit(0)).count() == 0


def test_full_text_takes_whole_words_and_no_empty_query(spark):
    df = spark.createDataFrame([(1, "the cat; the dog"), (2, "Cathedral dog"), (3, "dog CAT dog dog"), (4, None), (5, "")], "id int, text string")
    assert [r["id"] for r in memory.full_text(df, "cat dog", "text", "id").collect()] == [3, 1]
    assert memory.full_text(df, " ,; ", "text", "id").count() == 0
    assert round(memory.full_text(df, "dog", "text", "id").first()["rank"], 6) == 0.75


def test_core_files_are_loaded_once(spark):
    rows = [(1, "skills", 0, "base", True, "core"), (1, "agents", 5, "base", True, "core"), (1, "agents", 0, "base", False, "again"), (1, "agents", 1, "x", False, "own"), (1, "prompt", 0, "y", True, " "), (2, "prompt", 0, "base", True, "core")]
    df = spark.createDataFrame(rows, "ctx int, section string, ord int, name string, core boolean, text string")
    got = {(r["ctx"], r["section"], r["ord"], r["name"]) for r in assembly.core_once(df, ["ctx"]).collect()}
    assert got == {(1, "agents", -1, "base"), (1, "agents", 1, "x"), (2, "prompt", -1, "base")}


def test_paragraphs_of_a_hot_key_against_brute_force(spark):
    texts = [(i % 2, i, "\n\n".join(["same words"] * (i % 3) + [f"own {i % 7}", "  same \t words "] + ["\r\n"])) for i in range(60)] + [(0, 100, None), (0, 101, ""), (1, 102, "\n\n")]
    df = spark.createDataFrame(texts, "s int, ord int, text string")
    seen: set[tuple] = set()
    want = {}
    for s, o, t in texts:
        kept, gone = [], 0
        for par in (p.strip() for p in (t or "").replace("\r\n", "\n").split("\n\n")):
            key = (s, " ".join(par.split()))
            if par and key in seen:
                gone += 1
            elif par:
                seen.add(key)
                kept.append(par)
        want[o] = (None if t is None else "\n\n".join(kept), gone)
    got = {r["ord"]: (r["text"], r["paragraphs_removed"]) for r in sanitize.dedupe_paragraphs(df, ["s"], ["ord"]).collect()}
    assert got == want
