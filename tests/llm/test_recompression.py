import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import recompression as R


def names_of(words):
    names = R.Names()
    return np.array([names[w] for w in words], dtype=np.uint64)


@pytest.mark.parametrize("letters", [b"ab", b"abc", b"abcdefghijklmnop"])
def test_equal_windows_have_equal_anchors_in_any_surroundings(letters):
    rnd = random.Random(1)
    word = lambda: bytes([rnd.choice(letters)])
    for _ in range(200):
        inside = [word() for _ in range(13)]
        if rnd.random() < 0.3:
            k = rnd.randint(0, 13)
            inside = [word()] * k + [word()] * (13 - k)
        found = set()
        for _ in range(8):
            left, right = [word() for _ in range(rnd.randint(0, 30))], [word() for _ in range(rnd.randint(0, 30))]
            for rounds in (1, 2, 3):
                anchors, at, words = R.anchors(names_of(left + inside + right), 13, rounds)
                k = len(left)
                found.add((rounds, int(anchors[k]), int(at[k]) - k if at[k] >= 0 else None, int(words[k])))
        assert len(found) == 3


def test_largest_of_ranges():
    rnd = random.Random(2)
    keys = np.array([rnd.randint(0, 99) for _ in range(60)], dtype=np.uint64)
    lo = np.array([rnd.randint(0, 58) for _ in range(300)])
    hi = np.array([rnd.randint(a + 1, min(60, a + 13)) for a in lo])
    assert R._largest(keys, lo, hi).tolist() == [keys[a:b].max() for a, b in zip(lo, hi, strict=True)]


def rows_of(df, **options):
    out = R.remove_repeats(df, **options)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in out.withColumn("sha", F.sha2("kept", 256)).collect()), key=str)


def wanted(rows, window=13):
    return sorted(((i, *x) for (i, _), x in zip(rows, R.brute_force(rows, window), strict=True)), key=str)


def collected(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_messy_documents_match_brute_force(messy):
    assert rows_of(messy) == wanted(collected(messy))
    assert any(x[2] for x in wanted(collected(messy)))


@pytest.mark.parametrize("window", [3, 5, 13])
def test_few_words_long_runs_and_periods(spark, monkeypatch, window):
    monkeypatch.setattr(R, "CHUNK", 50)
    monkeypatch.setattr(R, "SEGMENT_WINDOWS", 7)
    rnd = random.Random(window)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(0, 120))) for _ in range(25)]
    texts += ["a " * 90, "a " * 40 + "b " * 40, "x " + "a " * 30 + "b " * 70, "a b " * 60, "b a b " * 40, "a b c d " * 30, "q a b c d a b c d a b c d a b c d r"]
    texts += texts[3:9] + ["a b " * 20, "é " * 30, "a\x1cb c " * 20]
    rows = [(rnd.choice([i, i, i % 9]), t) for i, t in enumerate(texts)] + [(None, texts[4]), (None, texts[4] + " zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rounds in (1, 2):
        assert rows_of(df, window=window, rounds=rounds) == wanted(rows, window)


def test_hot_anchors_are_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(R, "HOT_ANCHORS", 10_000)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdef", k=4))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, f"{' '.join(word() for _ in range(i % 5))} {passage} {' '.join(word() for _ in range(i % 7))}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(R.hot_anchors(df, 13, 1)[0]) > 2
    assert rows_of(df) == wanted(rows)


def test_query_matches_brute_force(spark):
    from tessera.llm import queries

    rows = collected(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = queries.op11_recompression(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == wanted(rows)


def test_clashing_columns_and_empty_table(messy, empty):
    df = messy.withColumns({"id": F.lit(1), "digest": F.lit("d"), "spans": F.lit(2), "n_removed": F.lit("x")})
    out = R.remove_repeats(df)
    assert set(df.columns) <= set(out.columns) and out.count() == df.count()
    assert R.remove_repeats(empty).count() == 0
