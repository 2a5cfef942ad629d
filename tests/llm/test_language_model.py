import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from tessera.llm import language_model as L

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 7


def test_messy_documents_match_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    counts: Counter = Counter()
    pairs: Counter = Counter()
    for i, t in rows:
        if fold(i) != 2:
            w = tokens(t)
            counts.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    total, v = sum(counts.values()), len(counts)
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in L.score_texts(messy).collect()), key=str)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, fold(i) == 2, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + v + 1)) for x in w), 6)))
    assert got == sorted(want, key=str)


def test_scores_are_the_mixture(messy, monkeypatch):
    """The model's score, with weights caught on the way, by plain counting."""
    caught = {}
    learn = L.learn_weights
    monkeypatch.setattr(L, "learn_weights", lambda cells, rounds=200: caught.setdefault("w", learn(cells, rounds)))
    got = {(r["id"], r["n_tokens"]): r["score"] for r in L.score_texts(messy).collect()}
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    counts: Counter = Counter()
    pairs: Counter = Counter()
    for i, t in rows:
        if fold(i) != 2:
            w = tokens(t)
            counts.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    total, v, weights = sum(counts.values()), len(counts), caught["w"]
    for i, t in rows:
        w, score = tokens(t), 0.0
        for h, x in zip([None, *w], w, strict=False):
            a = weights[int(L.bucket_of(np.array([counts[h]]))[0])]
            score += math.log10(a[0] * pairs[h, x] / max(counts[h], 1) + a[1] * counts[x] / total + a[2] / (v + 1))
        assert abs(got[i, len(w)] - score) < 1e-6 * max(1, abs(score))


def test_weights_are_learned_by_bucket():
    cells = pd.DataFrame([(0, 0.0, 50.0, 10), (0, 0.0, 0.0, 10), (3, 900.0, 1.0, 90), (3, 0.0, 2.0, 10)], columns=["bucket", "r2", "r1", "n"])
    w = L.learn_weights(cells)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all()
    assert w[0][0] == 0 and w[3][0] > 0.85
    assert np.array_equal(w[40], w[3]) and np.array_equal(w[2], w[1])


def test_held_out_texts_gain_over_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in L.score_texts(docs).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.3


def test_packing():
    a = np.array([0, 1, 255, 256, 2**40, 7])
    assert np.array_equal(L.unpack(L.pack(a)), a)
    h = np.sort(np.array([1 << 63, 5 << 20, (1 << 64) - 1], dtype=np.uint64))
    assert np.array_equal(L._from_short(L._short(h, 0)), h >> np.uint64(16))
    assert np.array_equal(L._from_short(L._short(h, 3)), (h << np.uint64(3)) >> np.uint64(16)) and L._bucket(h, 3).tolist() == [0, 4, 7]


def test_empty_table(empty):
    assert L.score_texts(empty).count() == 0


def test_small_blocks_and_relays_give_the_same(messy):
    rows = lambda **sizes: sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in L.score_texts(messy, **sizes).collect()), key=str)
    assert rows(block_tokens=300, relay_blocks=3, bucket_entries=2_000) == rows()


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "one"), ("b", None)], "name string, body string")
    out = L.score_texts(docs, "name", "body")
    assert out.schema["id"].dataType == docs.schema["name"].dataType
    assert sorted((r["id"] or "", r["n_tokens"]) for r in out.collect()) == [("", 2), ("a", 3), ("b", 1)]
