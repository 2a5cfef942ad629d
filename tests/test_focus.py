import pytest
from pyspark.sql import functions as F
from tessera.operators import focus, fused

FILES = [
    ("a/x.md", "# Intro one\nbody\n## Intro two\nmore\ntext"), ("a/b/y.py", "import z\ndef run(x):\n    one\n\n    two\nend\nclass Foo {\n a {\n}\n}\n"), ("q/x.md", "# Other\nIntro"),
    ("c.sql", "CREATE TABLE users (\n id int\n);\nselect 1"), ("j.json", '{"a": {"b": "v", "it\'s": [1,2], "n": null}}'), ("law.txt", "Artículo 1. Uno\nfoo\nArtículo 2. Dos\nbar"),
    ("log.txt", "2024-01-01 first thing\n more\n2024-01-02 second thing"), ("a/zz.txt", "alpha beta\ngamma beta alpha delta\n" + "\n".join(f"l{i}" for i in range(30))), ("empty.md", ""), ("k/run.go", "async run now"),
]
TARGETS = ["a/x.md", "x.md", "a/b", "b/", "a", "j.json#a.b", "j.json#a.it's", "j.json#a", "j.json#a.n", "users", "run", "Foo", "=run", "Intro", "articulo 2", "second thing", "*.md", "a/*.md", "beta gamma", "l15", "=Intro", "none", "x", "end", "", "=", "one two", "[x]", "a.b(c"]
COLUMNS = ["target", "source", "kind", "content", "prio"]


def test_one_pass_gives_what_the_resolvers_give(spark):
    files = spark.createDataFrame(FILES, "path string, content string").repartition(3)
    targets = spark.createDataFrame([(t,) for t in TARGETS] + [(None,)], "target string")
    old = sorted(map(tuple, focus.resolved(files, targets.where("target is not null")).select(*COLUMNS).collect()))
    new = sorted(map(tuple, fused.fused(files, targets).select(*COLUMNS).collect()))
    assert new == old and {r[4] for r in new} == set(range(10))


def test_one_scan_and_no_exchange(spark, tmp_path):
    spark.createDataFrame(FILES, "path string, content string").write.parquet(str(tmp_path / "files"))
    plan = fused.file_hits(spark.read.parquet(str(tmp_path / "files")), TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_bounds_and_odd_files(spark, monkeypatch):
    files = spark.createDataFrame([(f"d/f{i:02d}", "x") for i in range(30)] + [(None, "x"), ("d/none", None), ("d/f00", "x")], "path string, content string")
    monkeypatch.setattr(fused, "LISTED", 2)
    got = fused.fused(files, spark.createDataFrame([("d",)], "target string")).collect()
    assert [r["content"] for r in got] == ["d(30): f00, f01, ..."]
    assert fused.fused(files.limit(0), spark.createDataFrame([("d",)], "target string")).count() == 0
    assert fused.fused(files, spark.createDataFrame([], "target string")).count() == 0
    with pytest.raises(ValueError, match="targets"):
        fused.fused(files, spark.range(500).select(F.col("id").cast("string").alias("target")))


def test_keys_with_quotes(spark):
    files = spark.createDataFrame([("b.json", '{"x": {"it\'s": {"y?": 7}, "a.b": 1}}')], "path string, content string")
    targets = spark.createDataFrame([("b.json#x.it's",), ("b.json#x.it's.y?",), ("b.json#x.none",)], "target string")
    assert {r["target"]: r["content"] for r in focus.json_targets(files, targets).collect()} == {"b.json#x.it's": '{"y?":7}', "b.json#x.it's.y?": "7"}


ODD_FILES = [
    (None, "users and run"), ("n/null.md", None), ("n/sub/null.txt", None), ("Q.SQL", 'create table `Sh op`.x (a);\nCREATE TABLE "Ord"."Ers" (\n id int);'), ("/top.md", "# ÁRBOL Ñandú"), ("a//b.txt", "ἈΣ ΣΑ\nİx Straße"),
    ("g.json", "no json"), ("deep/a/x.md", "## intro three\n2024-02-02 second thing here\nalpha  beta"), ("none/", "x"),
]
ODD_TARGETS = ["ord.ers", "arbol nandu", "=ÁRBOL", "=arbol", "top.md", "null.md", "n", "n/sub/", "sub", "/", "//", "a/", "g.json#a", "/top.md#x", "ας", "=Σ", "ix", "i", "STRASSE", "**/*.txt", "?.SQL", "thing second", "run()", "=run()", "Foo()", "a#"]


def test_resolvers_find_in_the_candidates_what_they_find_in_all_files(spark):
    files = spark.createDataFrame(FILES + ODD_FILES, "path string, content string").repartition(3)
    # a blank target is in every file, so all would be candidates
    targets = spark.createDataFrame([(t,) for t in TARGETS + ODD_TARGETS if t.strip()] + [(None,)], "target string")
    want = sorted(map(repr, focus.resolved_in(files, targets).select(*COLUMNS).collect()))
    assert sorted(map(repr, focus.resolved(files, targets).select(*COLUMNS).collect())) == want and len(want) > 40


def test_resolvers_read_the_candidates_alone(spark, tmp_path):
    spark.createDataFrame(FILES + ODD_FILES, "path string, content string").write.parquet(str(tmp_path / "all"))
    files = spark.read.parquet(str(tmp_path / "all"))
    one = lambda *asked: spark.createDataFrame([(t,) for t in asked], "target string")
    assert not [f for f in focus.resolved(files, one("users")).inputFiles() if "/all/" in f]
    got = focus.candidates(files, one("a/b/", "k/run.go", "no such words")).collect()
    assert sorted(map(tuple, got)) == [("a/b/y.py", None), ("k/run.go", "async run now")]
    assert focus.candidates(files, spark.range(201).select(F.col("id").cast("string").alias("target"))) is files
    many = spark.range(200).select(F.concat(F.lit("k/run.go f"), "id").alias("target")).union(one("k/run.go"))
    assert focus.candidates(files, many.where("target <> 'k/run.go f7'")).count() == 1
