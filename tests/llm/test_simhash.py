import random

import numpy as np
import pytest
import xxhash
from tessera.llm import simhash as H
from tessera.llm.components import components


def plain_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    ids = list(range(len(rows)))
    prints = [plain_print(t) for _, t in rows]

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                ids[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_messy_documents_match_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = H.near_duplicates(messy).collect()
    assert sorted(((r["id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got), key=str) == brute_components(rows)


def near(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(6)]
    out = set(base)
    while len(out) < n:
        out.add(rnd.choice(list(base)) ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))}))
    return sorted(out)


@pytest.mark.parametrize("tile", [4, 16, 2048])
def test_tiles_lose_no_link(spark, tile):
    rnd = random.Random(tile)
    prints = near(rnd, 150)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in components(H.near_links(df, tile=tile)).collect()}
    rows, seen = [], {}
    for p in prints:
        rows.append(p)
    group = {p: p for p in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    for p in rows:
        seen.setdefault(group[p], set()).add(got.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p))
    assert all(len(s) == 1 for s in seen.values()) and len({next(iter(s)) for s in seen.values()}) == len(seen)


def test_tile_links_skip_nothing_in_reach():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 1 << 20, 300).astype(np.uint64)
    y = np.concatenate((x[:50] ^ np.uint64(5), rnd.integers(0, 1 << 20, 200).astype(np.uint64)))
    a, b = H.tile_links(x, y, 2, rows=16)
    linked = set(a.tolist()) | set(b.tolist())
    want = {int(p) for p in x for q in y if p != q and bin(int(p) ^ int(q)).count("1") <= 2}
    assert want <= linked


def test_tiles_out_of_reach_are_not_placed(spark):
    """One bucket, prints of 0 to 32 set bits in the other bands: of the pairs of tiles only those of near counts are placed."""
    rnd = random.Random(1)
    prints = {sum(1 << 32 + b for b in rnd.sample(range(32), rnd.randrange(33))) for _ in range(400)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 0, 0) for p in prints], "fp long, band int, key long")
    from pyspark.sql import functions as F

    pairs = H.cut_in_tiles(df, ["band", "key"], F.bit_count("fp"), F.xxhash64("fp"), 2, 40).select("lo", "hi").distinct().collect()
    tiles = {t for r in pairs for t in r}
    assert len(tiles) > 20 and all(abs((r["lo"] >> 32) - (r["hi"] >> 32)) <= 2 for r in pairs)
    assert len(pairs) < len(tiles) * (len(tiles) + 1) / 2 / 4


def test_equal_keys_of_different_bands_stay_apart(spark):
    """Bucket of the first pair of bands zero: two tiles, whose pair (0, 1) had the number of the second pair of bands' one tile."""
    rnd = random.Random(11)
    low = lambda: rnd.getrandbits(15) | 1 << 15
    large = {low() << 32 | low() << 48 for _ in range(150)}
    # zero in bands 0 and 2 alone: 45 links whose bits differ in bands 1 and 3, one bit each
    base = [low() << 16 | low() << 48 for _ in range(45)]
    small = set(base) | {p ^ (1 << 20 | 1 << 52) for p in base}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in sorted(large | small)], "fp long")
    got = {r["node"]: r["root"] for r in components(H.near_links(df, tile=100)).collect()}
    for p in base:
        assert got[signed(p)] == got[signed(p ^ (1 << 20 | 1 << 52))]


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 70)] + [(1000, i) for i in range(1001, 1040)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 1000 for i in range(1000, 1040)}


def test_one_of_each_group_stays(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    kept = H.keep_one(messy)
    assert kept.columns == messy.columns
    groups = {(c, p if c is None else None) for _, p, c in brute_components(rows)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({c for c, _ in groups if c is not None}) + sum(1 for c, _ in groups if c is None)
    assert {i for i in ids if i is not None} == {c for c, _ in groups if c is not None}


def test_empty_table(empty):
    assert H.near_duplicates(empty).count() == 0 and H.keep_one(empty).count() == 0
