import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import suffix_dedup as S


def brute_windows(texts, n):
    seen = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    return [np.array([i + n <= len(t) and seen[t[i : i + n]] > 1 for i in range(len(t))], dtype=bool) for t in texts]


def test_intervals_find_all_repeats():
    rnd = random.Random(2)
    for _ in range(60):
        n, letters = rnd.choice([2, 3, 5, 8]), rnd.choice([b"ab", b"abcd", bytes(range(240))])
        texts = [bytes(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(rnd.randint(1, 5))]
        texts.append(texts[0][3:40] + b"zz")
        for got, want in zip(S.repeated_windows(texts, [np.ones(len(t)) for t in texts], n), brute_windows(texts, n), strict=True):
            assert np.array_equal(got, want)


def test_common_prefixes_are_exact_below_the_limit():
    rnd = random.Random(4)
    for _ in range(30):
        sym = np.array([rnd.choice([1, 2, 3]) for _ in range(rnd.randint(2, 80))] + [0], dtype=np.uint8)
        order = S.suffix_order(sym, 8)
        lcp = S.common_prefixes(sym, order, 6)
        for i in range(1, len(sym)):
            a, b = sym[order[i - 1] :].tolist(), sym[order[i] :].tolist()
            k = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0), min(len(a), len(b)))
            if k < 6:
                assert lcp[i] == k


def rows_of(df, **options):
    out = S.dedup_substrings(df, **options).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    return sorted(((r["doc_id"], r["text"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out.collect()), key=str)


def wanted(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    texts = [(t or "").encode() for _, t in rows]
    return sorted(((i, t, len(b), *x) for (i, t), b, x in zip(rows, texts, S.brute_force(texts), strict=True)), key=str)


def test_messy_documents_match_brute_force(messy):
    assert rows_of(messy) == wanted(messy)


def test_crowded_anchors_and_tiny_blocks_give_the_same(messy):
    assert rows_of(messy, group_segments=1, block_bytes=3000) == wanted(messy)


def test_periodic_texts(spark):
    rnd = random.Random(8)
    unit = "".join(rnd.choices("abcdefgh ", k=130))
    texts = ["ab" * 4000, unit * 5, unit * 2 + "tail", "q" * 199, "q" * 200, "z" * 400, "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(df) == wanted(df)


def test_empty_table(empty):
    assert S.dedup_substrings(empty).count() == 0


def test_cut_merges_spans():
    kept, n = S._cut(b"0123456789", [{"start": 2, "end": 4}, {"start": 4, "end": 6}, {"start": 8, "end": 9}])
    assert kept == b"01679" and n == 2 and hashlib.sha256(kept)
