import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tessera.llm import spelling as S


def brute_words(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=10):
    """Deletion neighbourhoods propose, comparison decides."""
    by = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_random_words_of_few_letters(spark):
    rnd = random.Random(1)
    words = {"".join(rnd.choices("ab", k=rnd.randint(1, 7))): rnd.choice([1, 2, 5, 20, 300, 4000]) for _ in range(150)}
    words |= {"".join(rnd.choices("aàz", k=rnd.randint(3, 9))): rnd.choice([1, 10, 100, 1000]) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.spelling_variants(df)) == brute_variants(words)


def test_many_ranges(spark):
    rnd = random.Random(2)
    words = {"comm" + "".join(rnd.choices("abc", k=rnd.randint(2, 8))): rnd.choice([1, 10, 100]) for _ in range(900)}
    words |= {"a" * k: 10**k for k in range(1, 9)} | {"z" * 3000: 5, "z" * 3001: 50, "z" * 2999 + "y": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, ranges = S.sorted_ranges(df, "word", "test-ranges")
        assert len(ranges) > 20
        assert rows_of(S.spelling_variants(df)) == brute_variants(words)
        assert rows_of(S.spelling_variants(df, range_words=25)) == brute_variants(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_counted_documents(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    for every, want in ((31, brute_words(rows)), (3, brute_words(rows, 3))):
        assert {r["word"]: r["n"] for r in S.count_words(messy, typo_every=every).collect()} == want
    assert rows_of(S.spelling_variants(S.count_words(messy, typo_every=3))) == brute_variants(brute_words(rows, 3))


def test_query_matches_brute_force(spark):
    from tessera.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_variants(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert any(r[1] for r in want)
    assert rows_of(queries.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == want


def test_odd_tables(spark, empty):
    df = spark.createDataFrame([("abcdefg", 1), ("abcdefg", 2), (None, 5), ("abcdefh", None), ("abcdefgh", 30), ("", 1), ("x", 10)], "word string, n long").withColumns({"id": F.lit("x"), "form": F.lit(1)})
    assert rows_of(S.spelling_variants(df)) == brute_variants({"abcdefg": 3, "abcdefgh": 30, "": 1, "x": 10})
    assert S.spelling_variants(S.count_words(empty)).count() == 0
