import re

from tessera.llm import decontaminate as D
from tessera.llm import oracles, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in wins:
                hit |= set(range(s, s + n))
                ids.add(i)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(w)


def test_query_matches_sql(spark, duck, same):
    same(queries.op5_decontaminate(spark, "/root/testdata/sf0.001"), duck, oracles.OP5)


def items_of(messy):
    texts = [r["text"] for r in messy.where("doc_id < 30").collect()]
    items = [(i, " ".join(words(t)[2:25])) for i, t in enumerate(texts[:8])]
    return items + [(50, None), (51, ""), (52, "ONE two"), (53, "one"), (54, items[0][1]), (None, items[1][1]), (55, "same same same line"), (56, "no match whatsoever for this one")]


def test_messy_documents_match_brute_force(spark, messy, monkeypatch):
    items = items_of(messy)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r["doc_id"], *brute(r["text"], items)) for r in messy.collect()), key=str)
    for most in (D.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(D, "BROADCAST_ENTRIES", most)
        rows = D.contamination(messy, table).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in rows), key=str) == want


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(messy, none).where("n_hit > 0 or contaminated").count() == 0
    assert D.contamination(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
