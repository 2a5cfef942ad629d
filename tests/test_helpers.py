"""Small functions that no query runs alone."""

import html
import random

from pyspark.sql import functions as F
from tessera.functions import labels
from tessera.operators import assembly, conversation, jobs, sanitize, search
from tessera.sources.html import html_blocks, unescaped


def values(spark, rows, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_character_references(spark):
    rows = ["a &lt;b&gt; &amp;amp; &quot;x&quot;", "&eacute;&copy &notin; &notit; &AMP", "&#233;&#xE9;&#XE9 &#0; &#x110000; &#xD800; &#99999999999999;", "&#150;&#151; &;&#; &#x; & &&", "&nosuch; &NotEqualTilde;", "plain", "", "&#128512;"]
    got = values(spark, rows, unescaped)
    assert got == [html.unescape(r).replace(" ", " ") for r in rows]
    assert values(spark, [None, "a&nbsp;b"], unescaped) == [None, "a b"]


def test_blocks_under_the_last_opened_tag(spark):
    page = "<html><H1 class=x>Top</h1>after<p>one<b> two</b></p>three<li>four<br>five</li><style>p {}</style>"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "no tags &amp; none")], "page_id int, html string")
    got = {}
    for r in html_blocks(df).orderBy("page_id").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], r["text"]))
    assert got == {1: [("p", "Top")][:0] + [("h1", "Top"), ("h1", "after"), ("p", "one two"), ("p", "three"), ("li", "four"), ("br", "five")], 4: [("p", "no tags & none")]}


def test_references_of_pages_match_brute_force(spark):
    import hashlib
    import re

    from tessera.plans import registry

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    tags = "h1|h2|h3|p|li|br|div"
    for r in registry()["html_references"][0](spark, sf).collect():
        body = "<p>" + re.sub("(?is)<script[^>]*>.*?</script>", "", re.sub("(?is)<style[^>]*>.*?</style>", "", pages[r["page_id"]]))
        texts = [html.unescape(re.sub("(?s)<[^>]*>", "", t).strip()).replace("\u00a0", " ") for t in re.split(f"(?is)</?(?:{tags})[^>]*>", body)]
        texts = sorted(t for t in texts if t)
        assert (r["blocks"], r["chars"], r["texts_sha256"]) == (len(texts), sum(map(len, texts)), hashlib.sha256("\n".join(texts).encode()).hexdigest())


def test_text_outside_fences(spark):
    rnd = random.Random(4)
    texts = ["\n".join(rnd.choice(["```", "``` py", " ```", "a", "", " b ", "x``` no"]) for _ in range(rnd.randint(1, 12))) for _ in range(80)] + ["", "```", "a\n```\n```\nb", "a\n```\n\n```\nb", "open\n```\nrest"]

    def brute(t):
        inside, kept = False, []
        for line in t.split("\n"):
            if line.strip().startswith("```"):
                inside = not inside
            elif not inside:
                kept.append(line)
        return "\n".join(kept).strip()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r["text"] for r in conversation.strip_code(df).orderBy("i").collect()] == [brute(t) for t in texts]


def test_log_helpers(spark):
    rows = spark.createDataFrame([("a", 1)], "x string, y int")
    assert [r["line"] for r in jobs.log_lines(rows, "x", "y").collect()] == ['{"x":"a","y":1}']
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-07 23:59:59"), ("2024-01-01 00:00:00", "2024-01-08 00:00:00")], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert [r["r"] for r in df.select(jobs.rotation_due(F.col("a"), F.col("b"), "weekly").alias("r")).collect()] == [False, True]


def test_schedules_that_cannot_be_read(spark):
    rows = [("a", "0 2 * * *"), ("b", "61 * * * *"), ("c", "1 2 3"), ("d", None)]
    got = {r["job"]: r["error"] for r in jobs.schedule_errors(spark.createDataFrame(rows, "job string, schedule string")).collect()}
    assert got["a"] is None and all(got[k] for k in "bcd") and got["c"] == "a schedule has five fields"


def test_names_blocks_and_patterns(spark):
    assert values(spark, ["b,a,b,,a"], lambda v: sanitize.dedupe_names(F.split(v, ","))) == [["b", "a"]]
    assert values(spark, ["x\n```memory 1\nkeep\nthis\n```\n```memory\nno\n```", "none", None], assembly.memory_block) == ["keep\nthis", None, None]
    left = search.unmatched(spark.createDataFrame([("a",), ("b",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string"))
    assert [r["path"] for r in left.collect()] == ["b"]
    assert callable(labels.any_cloud)
