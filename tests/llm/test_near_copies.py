import random

import corpus_pipeline as P
import pytest
from tessera.llm import simhash as J


def plain_set(text, size=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_keep(rows):
    """Ids of the documents that stay, of rows (id, text): the least of each component of Jaccard >= 0.8."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or 10 * len(sets[i] & sets[j]) >= 8 * union:
                group[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append((doc is None, doc or 0))
    return sorted((min(x) for x in least.values()), key=str)


def kept(docs):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()), key=str)


def near_copies(seed, n=120):
    """Texts at every distance from each other: edits of earlier texts, chains of them, and passages that many share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    common = [word() for _ in range(40)]
    out: list = []
    for i in range(n):
        if i % 3 and out:
            t = list(rnd.choice(out[-12:]))
            for _ in range(rnd.randrange(5)):
                t[rnd.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rnd.randint(3, 120))]
            t = t + common if i % 2 else t
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_stage_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert kept(P.near_duplicates(spark, docs, d)) == brute_keep(rows)


@pytest.mark.parametrize("frequent", [3, 30])
def test_edits_and_shared_passages_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rows = near_copies(frequent)
    want = brute_keep(rows)
    assert 20 < len(want) < len(rows) - 20
    assert kept(J.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_messy_documents_match_brute_force(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    assert kept(J.keep_one_copy(messy)) == brute_keep(rows)
    assert J.keep_one_copy(empty).count() == 0


@pytest.mark.parametrize("tile", [5, 40])
def test_tiles_of_large_buckets_lose_no_link(spark, tile):
    """Edits of one text, all in the same buckets, which are cut into tiles."""
    rnd = random.Random(tile)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(500)}"
        rows.append((i, " ".join(t)))
    want = brute_keep(rows)
    assert 1 < len(want) < 60
    assert kept(J.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)) == want


def test_forest_prefers_near_pairs():
    import numpy as np

    a, b, bits = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]), np.array([5, 9, 1, 7])
    assert J.nearest_first(a, b, bits, 5).tolist() == [0, 2, 3]


def test_sketches_never_tell_more_than_the_difference():
    import numpy as np
    from tessera.llm import simhash

    rnd = np.random.default_rng(5)
    for n, gone in ((1, 1), (10, 3), (300, 40), (3000, 500), (20_000, 3000)):
        own = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate((own[min(gone, len(own) - 1) :], rnd.integers(0, 1 << 63, gone, dtype=np.uint64))))
        told = simhash.differences([simhash.sketch(own)], [simhash.sketch(other)])[0]
        assert 0 < told <= len(np.setxor1d(own, other))
    assert simhash.differences([simhash.sketch(own)], [simhash.sketch(own)])[0] == 0
