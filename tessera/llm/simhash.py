"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints meet in buckets. At a small radius r these are of equal bands:
cutting 64 bits into r + 2 bands leaves at least two bands equal, so every link
lies in a bucket of some pair of bands. A bucket of more than TILE fingerprints
is cut into tiles by population count; pairs of tiles whose counts differ beyond
the radius are left out before anything is shuffled. Tiles are compared with
numpy exclusive-or and bit counts and give a spanning forest of their links,
never all pairs.

near_copies() links texts by the Jaccard similarity of their word shingles. There
the buckets are rare shingles, of which similar sets share one, the fingerprints
have 128 bits, the radius is as wide as the similarity needs, and links are
verified by the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hot_keys, materialize, salted_join, small_batches, spark_of
from tessera.llm.components import components

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Fingerprints of a tile; fuller buckets are cut into tiles that are spread over tasks.
TILE = 2048
#: Of near copies: words of a shingle; bits of 128 by which sets of a similarity of 4/5 differ at most. On average 19 do, of very small sets 24 with a deviation of 4.4.
COPY_SHINGLE = 5
COPY_RADIUS = 44
SKETCH_BYTES = 256 + 1024
#: Least share of the texts, and least number, whose shingles are counted to put frequent ones last; the texts of them that make one frequent; the most that are told apart. The order changes the work, never the result.
SAMPLE_SHARE = 1 / 16
SAMPLE_DOCS = 4_000
FREQUENT = 4
MOST_FREQUENT = 200_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.array([], dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 of the word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fp, the 64 bits as a long, in place of any fp of their own; null and empty texts have 0."""
    small_batches(spark_of(docs))

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text_col)))


def band_keys(fp: Column, radius: int) -> Column:
    """array<struct<band, key>>: the values of every pair of r + 2 bands."""
    n = radius + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return F.array(*[F.struct(F.lit(i).alias("band"), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b])).cast("long")).alias("key")) for i, (a, b) in enumerate(combinations(range(n), 2))])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links a-b: each point beside the least one of its component."""
    points, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(points))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            keep = root != np.arange(len(points))
            return points[keep], points[root[keep]]
        root = new


def in_reach(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, differing bits) within the radius, strip by strip of x. x and y: (n, words) bits in order of bit count; strips out of reach are skipped."""
    px, py = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x, y))
    for i in range(0, len(x), rows):
        p = px[i : i + rows]
        lo, hi = np.searchsorted(py, p[0] - radius), np.searchsorted(py, p[-1] + radius, side="right")
        if lo < hi:
            bits = sum(np.bitwise_count(x[i : i + rows, None, w] ^ y[None, lo:hi, w]).astype(np.uint16) for w in range(x.shape[1]))
            u, v = np.nonzero(bits <= radius)
            yield u + i, v + lo, bits[u, v]


def tile_links(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of 64-bit fingerprints."""
    x, y = (z[np.argsort(np.bitwise_count(z), kind="stable")] for z in (x, y))
    found = [(x[u], y[v]) for u, v, _ in in_reach(x[:, None], y[:, None], radius, rows)]
    a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (x[:0], x[:0])
    return forest(a[a != b], b[a != b]) if (a != b).any() else (a[:0], b[:0])


def neighbours(no: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places i, distance d) of all pairs i, i + d inside runs of equal no, of runs of up to `most`, all runs at once."""
    starts = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1]))) if len(no) else np.array([], dtype=np.int64)
    size = np.diff(np.append(starts, len(no)))
    small = np.repeat(size <= most, size)
    for d in range(1, min(most, len(no))):
        near = np.flatnonzero(small[:-d] & (no[d:] == no[:-d]))
        if not len(near):
            break
        yield near, d


def cut_in_tiles(rows: DataFrame, keys: list[str], ones: Column, spread: Column, radius: int, tile: int) -> DataFrame:
    """rows of buckets (keys) of two or more, with lo and hi, the tiles of a pair, and side (0 in lo, 1 in hi), in order of (keys, lo, hi, side, __ones).

    A bucket of up to `tile` rows is one tile. Others are cut by population
    count, and a count of many rows by `spread`; a tile is paired with itself
    and with those whose counts are within the radius, so what is out of reach
    is never placed.
    """
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    met = salted_join(rows, sizes, keys, hot_keys(sizes, keys, "n"), spread).withColumn("__ones", ones)
    met = materialize(met, "simhash-met")
    alone = met.where(F.col("n") <= tile).drop("n").withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long"), "side": F.lit(0)})
    classes = met.where(F.col("n") > tile).groupBy(*keys, "__ones").agg(F.count("*").alias("m"))
    classes = classes.groupBy(*keys).agg(F.sum("m").alias("n"), F.collect_list(F.struct("__ones", F.ceil(F.col("m") / tile).cast("int").alias("cuts"))).alias("classes"))
    classes = materialize(classes, "simhash-classes")
    large = salted_join(met.where(F.col("n") > tile).drop("n"), classes.drop("n"), keys, hot_keys(classes, keys, "n"), spread)
    number = lambda c, cut: c["__ones"].cast("long") * (1 << 32) + cut
    reach = F.filter("classes", lambda c: F.abs(c["__ones"] - F.col("__ones")) <= radius)
    others = F.flatten(F.transform(reach, lambda c: F.transform(F.sequence(F.lit(0), c["cuts"] - 1), lambda i: number(c, i))))
    own = F.filter("classes", lambda c: c["__ones"] == F.col("__ones"))[0]
    large = large.withColumn("own", number(own, F.pmod(spread, own["cuts"]))).withColumn("other", F.explode(others))
    large = large.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": F.when(F.col("own") <= F.col("other"), 0).otherwise(1)})
    placed = alone.unionByName(large.drop("classes", "own", "other"))
    return placed.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "side", "__ones")


def whole_tiles(frames: Iterator[pd.DataFrame], keys: list[str], most: int = 20_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, number of the tile pair of each row): whole pairs of tiles, put together until they have `most` rows."""
    names = [*keys, "lo", "hi"]

    def numbered(block: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        new = np.zeros(len(block), dtype=bool)
        for c in names:
            v = block[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return block, np.cumsum(new)

    held: list[pd.DataFrame] = []
    for frame in frames:
        if len(frame):
            last = frame.iloc[-1]
            open_rows = np.logical_and.reduce([frame[c].to_numpy() == last[c] for c in names])
            held.append(frame[~open_rows])
            if not open_rows.all() and sum(map(len, held)) >= most:
                yield numbered(pd.concat(held, ignore_index=True))
                held = []
            held.append(frame[open_rows])
    if held:
        yield numbered(pd.concat(held, ignore_index=True))


def pieces(no: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of equal no of over `least` rows."""
    edge = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1], [True])))
    return ((a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > least)


def compare(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """A spanning set of the links in tile pairs of rows (band, key, lo, hi, side, fp)."""
    for block, no in whole_tiles(frames, ["band", "key"]):
        fp, side = block["fp"].to_numpy().view(np.uint64), block["side"].to_numpy()
        ones = np.bitwise_count(fp).astype(np.int16)
        a, b = [fp[:0]], [fp[:0]]
        cross = np.maximum.reduceat(block["hi"].to_numpy() - block["lo"].to_numpy(), np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1])))) > 0
        alone = ~cross[no]
        x, ones = fp[alone], ones[alone]
        for i, d in neighbours(no[alone], 64):
            i = i[ones[i + d] - ones[i] <= radius]  # in order of bit count
            i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
            a.append(x[i])
            b.append(x[i + d])
        for lo, hi in pieces(no, 0):
            if cross[no[lo]] or hi - lo > 64:
                x, y = (fp[lo:hi][side[lo:hi] == z] for z in (0, 1))
                u, v = tile_links(x, y if cross[no[lo]] else x, radius)
                a.append(u)
                b.append(v)
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = forest(a, b) if len(a) else (a, b)
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: a spanning set of the links among the distinct fingerprints of prints (fp)."""
    distinct = prints.select("fp").distinct()
    keyed = distinct.select("fp", F.inline(band_keys(F.col("fp"), radius)))
    placed = cut_in_tiles(keyed, ["band", "key"], F.bit_count("fp"), F.xxhash64("fp"), radius, tile)
    return placed.mapInPandas(lambda it: compare(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, k1, k2 (digests of the text), fp (long), component_id, root (a fingerprint that stands for the component).

    component_id: the least id reachable over links of `radius` differing bits
    or fewer. Equal fingerprints are linked, so a component holds all documents
    of its fingerprints; null and empty texts have fingerprint 0, linked like
    any other. A null id counts as greater than all. Repeated rows stay rows;
    an empty table gives none; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = fingerprints(rows).select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"), "fp")
    rows = materialize(rows, "simhash-prints")
    least = rows.groupBy("fp").agg(F.min("id").alias("id"))
    linked = components(near_links(rows, radius))
    placed = least.join(linked, least["fp"] == linked["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(placed.select("fp", "root").join(firsts, "root"), "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component: the one of least id stays (null last; ties by digests of the text)."""
    return one_of_each(docs, near_duplicates(docs, radius, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without all but the first document of each root of rows (id, k1, k2, root)."""
    same = rows.groupBy("root", "id", "k1", "k2").agg(F.count("*").alias("times"))
    chosen = same.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "times")).alias("first")).select("first.id", "first.k1", "first.k2", "first.times")
    chosen = materialize(chosen.select(F.col("id").alias("__id"), F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("times").alias("__times")), "simhash-chosen")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"))
    found = keyed.join(chosen, (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id")))
    # only rows that repeat each other, id and text, have to meet once more
    repeated = found.where("__times > 1").dropDuplicates(["__k1", "__k2", id_col])
    return found.where("__times = 1").unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def shingle_set(text: str | None, size: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; empty without words."""
    return np.unique(shingle_hashes(text, size))


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last, one of which is in every set of a similarity of 4/5."""
    last = np.isin(own, frequent, assume_unique=True)
    return np.concatenate((own[~last], own[last]))[: len(own) - math.ceil(4 * len(own) / 5) + 1]


def frequent_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted shingles that FREQUENT of a sample of different texts hold."""

    @F.pandas_udf("array<long>")
    def shingles(s: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size).view(np.int64) for t in s])

    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, texts.count())))
    sample = texts.sample(share, seed=SEED).distinct()
    found = sample.select(F.explode(shingles("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    most = found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()["h"]
    return np.sort(most.to_numpy(dtype=np.int64).view(np.uint64))


def wide_print(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, as two signed longs: the majority of their XXH64, and of these mixed once more."""
    more = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (majority(own), majority(more ^ (more >> np.uint64(29)))))


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """texts (id, text, k1, k2) with, for text, set_id (a digest of the shingles), size, f1, f2 (wide_print) and prefix."""
    frequent = frequent_shingles(texts.select("text"), size)

    @F.pandas_udf("set_id long, size int, f1 long, f2 long, prefix array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            own = [shingle_set(t, size) for t in s]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], dtype=np.uint64).view(np.int64)
            f1, f2 = zip(*map(wide_print, own), strict=True) if own else ((), ())
            yield pd.DataFrame({"set_id": ids, "size": [len(x) for x in own], "f1": f1, "f2": f2, "prefix": [prefix(x, frequent).view(np.int64) for x in own]})

    return texts.withColumn("p", sets("text")).select("id", "k1", "k2", "p.*")


def nearest_first(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges (a, b: 0 to n - 1) of a spanning forest that prefers few differing bits."""
    root = np.arange(n)
    kept: list[np.ndarray] = []
    places = np.arange(len(a))
    while len(places):
        x, y = root[a[places]], root[b[places]]
        open_ = x != y
        places, x, y = places[open_], x[open_], y[open_]
        if not len(places):
            break
        # of every component the edge of least bits, then of least place
        order = np.lexsort((places, bits[places]))
        best = np.full(n, -1)
        for end in (x, y):
            first, at = np.unique(end[order], return_index=True)
            new = order[at]
            old = best[first]
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            better = (old < 0) | (rank[new] < rank[np.maximum(old, 0)])
            best[first[better]] = new[better]
        chosen = np.unique(best[best >= 0])
        kept.append(places[chosen])
        while True:
            low = np.minimum(root[x[chosen]], root[y[chosen]])
            new = root.copy()
            np.minimum.at(new, root[x[chosen]], low)
            np.minimum.at(new, root[y[chosen]], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            new = new[root]
            if np.array_equal(new, root):
                break
            root = new
    return np.unique(np.concatenate(kept)) if kept else places


def fitting(block: pd.DataFrame, no: np.ndarray, radius: int, least: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(u, v, differing bits, tile): places of pairs of sets of different components in tile pairs of rows (h, lo, hi, side, set_id, size, f1, f2, root) whose sizes allow a similarity of 4/5 and whose bits are in reach, strip by strip; those of all buckets of up to `least` rows have tile -1."""
    size, root, side = (block[c].to_numpy() for c in ("size", "root", "side"))
    bits = block[["f1", "f2"]].to_numpy().view(np.uint64)
    cross = np.maximum.reduceat(block["hi"].to_numpy() - block["lo"].to_numpy(), np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1])))) > 0

    def fit(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (root[u] != root[v]) & (5 * size[u] >= 4 * size[v]) & (5 * size[v] >= 4 * size[u])

    alone = np.flatnonzero(~cross[no])
    for i, d in neighbours(no[alone], least):
        u, v = alone[i], alone[i + d]
        ok = fit(u, v)
        u, v = u[ok], v[ok]
        apart = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1)
        ok = apart <= radius
        yield u[ok], v[ok], apart[ok], -1
    for lo, hi in pieces(no, 0):
        if cross[no[lo]] or hi - lo > least:
            x, y = (lo + np.flatnonzero(side[lo:hi] == z) for z in (0, 1))
            y = y if cross[no[lo]] else x
            for u, v, apart in in_reach(bits[x], bits[y], radius):
                u, v = x[u], y[v]
                ok = fit(u, v) & (u < v)
                yield u[ok], v[ok], apart[ok], lo


def candidates(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of sets of the fitting ones in tile pairs: those of a forest of near ones in each."""
    for block, no in whole_tiles(frames, ["h"]):
        ids = block["set_id"].to_numpy()
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        small: list[tuple[np.ndarray, np.ndarray]] = []
        for u, v, apart, at in fitting(block, no, radius):
            if at < 0:
                small.append((u, v))
                continue
            u, v, apart = (np.concatenate(e) for e in zip(kept[at], (u, v, apart), strict=True)) if at in kept else (u, v, apart)
            ok = nearest_first(u - at, v - at, apart, len(ids) - at)
            kept[at] = (u[ok], v[ok], apart[ok])
        found = small + [(u, v) for u, v, _ in kept.values()]
        if found:
            u, v = (ids[np.concatenate(e)] for e in zip(*found, strict=True))
            yield pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)}).drop_duplicates()


def involved(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Those rows of tile pairs that are in a fitting pair: at most as many as come in."""
    for block, no in whole_tiles(frames, ["h"]):
        met = np.zeros(len(block), dtype=bool)
        for u, v, _, _ in fitting(block, no, radius):
            met[u] = met[v] = True
        yield block[met]


def differences(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many shingles the sets of sketches x and y differ at least."""
    u, v = (np.frombuffer(b"".join(z), dtype=np.uint8).reshape(-1, SKETCH_BYTES) for z in (x, y))
    counts = np.abs(u[:, :256].astype(np.int16) - v[:, :256].astype(np.int16)).sum(axis=1, dtype=np.int64)
    odd = np.bitwise_count(u[:, 256:] ^ v[:, 256:]).sum(axis=1, dtype=np.int64)
    return np.maximum(counts, odd)


def close_sketches(sketches: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs u, v have sketches that allow a similarity of 4/5: the sets differ in a ninth of their sizes at most."""
    ok = np.empty(len(u), dtype=bool)
    for i in range(0, len(u), 4096):
        x, y = u[i : i + 4096], v[i : i + 4096]
        ok[i : i + 4096] = 9 * differences(sketches[x].tolist(), sketches[y].tolist()) <= size[x] + size[y]
    return ok


def sketched(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Those rows of tile pairs (with sketch) that are in a fitting pair whose sketches are close; without sketch."""
    for block, no in whole_tiles(frames, ["h"]):
        flat, size = block["sketch"].to_numpy(), block["size"].to_numpy().astype(np.int64)
        met = np.zeros(len(block), dtype=bool)
        for u, v, _, _ in fitting(block, no, radius):
            ok = close_sketches(flat, size, u, v)
            met[u[ok]] = met[v[ok]] = True
        yield block[met].drop(columns="sketch")


def alike(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """A spanning forest (a, b) of the links of a similarity of 4/5 or more in tile pairs of rows with hashes and sketch: never more than the rows."""
    for block, no in whole_tiles(frames, ["h"], 4_000):
        ids, size = block["set_id"].to_numpy(), block["size"].to_numpy()
        own = block["hashes"].to_numpy()
        flat = block["sketch"].to_numpy()
        a, b = [ids[:0]], [ids[:0]]
        for u, v, _, _ in fitting(block, no, radius):
            ok = close_sketches(flat, size.astype(np.int64), u, v)
            u, v = u[ok], v[ok]
            for i in range(0, len(u), 8192):
                x, y = u[i : i + 8192], v[i : i + 8192]
                both = np.array([len(np.intersect1d(own[p], own[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)], dtype=np.int64)
                ok = 9 * both >= 4 * (size[x] + size[y]).astype(np.int64)
                a.append(ids[x[ok]])
                b.append(ids[y[ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = forest(a, b) if len(a) else (a, b)
        yield pd.DataFrame({"a": a, "b": b})


def sketch(own: np.ndarray) -> bytes:
    """Counts of the shingles by their first byte, up to 255, then bits: whether an odd number of them ends in each value of 13 bits. Two sets differ in at least as many shingles as the counts, and as the bits."""
    counts = np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8)
    odd = np.bincount((own & np.uint64(8191)).astype(np.int64), minlength=8192) & 1
    return counts.tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def whole_sets(named: DataFrame, sets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """set_id, size, hashes, sketch of the sets of named (set_id), from one text each. sets: set_id, size, k1, k2 of a text that has the set; texts: k1, k2, text."""

    @F.pandas_udf("hashes array<long>, sketch binary")
    def shingles(s: pd.Series) -> pd.DataFrame:
        own = [shingle_set(t, size) for t in s]
        return pd.DataFrame({"hashes": [x.view(np.int64) for x in own], "sketch": [sketch(x) for x in own]})

    keys = sets.join(named.distinct(), "set_id", "left_semi").select("set_id", "size", "k1", "k2")
    own = texts.join(keys, ["k1", "k2"]).dropDuplicates(["set_id"]).select("set_id", "size", shingles("text").alias("own"))
    return materialize(own.select("set_id", "size", "own.*"), "simhash-sets")


def similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have a similarity of 4/5 or more; own: the whole_sets() of them.

    Such sets differ in a ninth of their sizes at most; pairs whose sketches
    differ in more go before whole sets are sent to their pairs.
    """

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(differences(x.tolist(), y.tolist()))

    a, b = (own.select(F.col("set_id").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = pairs.join(a, "a").join(b, "b").where(9 * apart("sa", "sb") <= F.col("na") + F.col("nb"))
    near = materialize(near.select("a", "b"), "simhash-near")
    a = own.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    b = own.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = near.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    return materialize(found, "simhash-links")


def different_tiles(rows: DataFrame) -> DataFrame:
    """rows (h, lo, hi, side, set_id) of tile pairs, of those with equal members only one."""
    told = [F.bit_xor(F.xxhash64(*seed, "side", "set_id")).alias(s) for s, seed in (("s1", []), ("s2", [F.lit(1)]))]
    members = rows.groupBy("h", "lo", "hi").agg(F.count("*").alias("n"), *told)
    one = members.groupBy("n", "s1", "s2").agg(F.min(F.struct("h", "lo", "hi")).alias("t")).select("t.*")
    return rows.join(one.hint("merge"), ["h", "lo", "hi"], "left_semi").select(rows.columns)


def copy_links(sets: DataFrame, prefixes: DataFrame, texts: DataFrame, size: int, radius: int = COPY_RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links of set_ids that span the components of similar sets.

    sets: set_id, size, f1, f2, k1, k2; prefixes: set_id, h, which may repeat
    each other. Buckets with equal members are one. First every bucket gives a forest of the pairs nearest to
    each other. Of what these leave apart, sets in reach of another go back to
    their tiles with all their shingles; there all pairs in reach are verified,
    and only a forest of the true links leaves a tile. So rows grow with the
    sets, though the comparisons of a crowded bucket are as many as its pairs.
    """
    shared = prefixes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "simhash-shared")
    spread = F.xxhash64("set_id")
    held = materialize(salted_join(prefixes, shared.select("h"), ["h"], hot_keys(shared, ["h"], "n"), spread).distinct(), "simhash-held")
    members = held.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(spread).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("s2"))
    members = materialize(members.where("n > 1"), "simhash-members")
    kept = members.groupBy("n", "s1", "s2").agg(F.min("h").alias("h")).select("h", "n")
    kept = materialize(kept, "simhash-kept")
    held = salted_join(held, kept.select("h"), ["h"], hot_keys(kept, ["h"], "n"), spread)
    held = materialize(held.join(sets.select("set_id", "size", "f1", "f2"), "set_id"), "simhash-held")
    ones = F.bit_count("f1") + F.bit_count("f2")

    def placed(rows: DataFrame) -> DataFrame:
        return cut_in_tiles(rows, ["h"], ones, spread, radius, tile)

    near = placed(held.withColumn("root", F.col("set_id"))).mapInPandas(lambda it: candidates(it, radius), "a long, b long")
    near = materialize(near.distinct(), "simhash-pairs")
    # the forests reach every set that is in reach of another, so no other set is needed below
    own = whole_sets(near.select(F.col("a").alias("set_id")).union(near.select("b")), sets, texts, size)
    first = similar(near, own)
    linked = components(first)
    rooted = held.join(linked, held["set_id"] == linked["node"], "left").drop("node").withColumn("root", F.coalesce("root", "set_id"))
    open_ = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("h", "n")
    open_ = materialize(open_, "simhash-open")
    rest = salted_join(rooted, open_.select("h"), ["h"], hot_keys(open_, ["h"], "n"), spread)
    rest = placed(rest)
    rest = materialize(rest.mapInPandas(lambda it: involved(it, radius), rest.schema), "simhash-involved")
    order = ["h", "lo", "hi", "side", "__ones"]

    def sent(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(own.select("set_id", *columns), "set_id").repartition("h", "lo", "hi").sortWithinPartitions(*order)

    # sets that meet in many tiles meet once, and only those with close sketches are sent whole
    rest = materialize(sent(different_tiles(rest), "sketch").mapInPandas(lambda it: sketched(it, radius), rest.schema), "simhash-sketched")
    whole = sent(different_tiles(rest), "hashes", "sketch")
    last = materialize(whole.mapInPandas(lambda it: alike(it, radius), "a long, b long"), "simhash-links")
    return first.union(last)


def near_copies(docs: DataFrame, size: int = COPY_SHINGLE, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: id, k1, k2 (digests of the text), set_id, root (a set that stands for the component).

    Texts whose sets of shingles have a Jaccard similarity of 4/5 or more are
    linked; texts of fewer words than a shingle are one shingle, and null texts
    and those without words are linked with each other alone. Every similar
    pair shares a shingle of its prefixes and is compared there; it would be
    lost only if its fingerprints differed by over COPY_RADIUS bits, which has
    a probability of some millionths. Shingles are told apart by 64 bits.
    Repeated rows stay rows; an empty table gives none.
    """
    small_batches(spark_of(docs))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = materialize(shingled(texts, size), "simhash-rows")
    one = rows.groupBy("set_id").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("size").alias("size"), F.first("f1").alias("f1"), F.first("f2").alias("f2"))
    one = materialize(one.select("set_id", "k.k1", "k.k2", "size", "f1", "f2"), "simhash-one")
    links = copy_links(one, rows.select("set_id", F.explode("prefix").alias("h")), texts.select("k1", "k2", "text"), size, tile=tile)
    linked = components(links)
    ids = rows.select("id", "k1", "k2", "set_id")
    return ids.join(linked, ids["set_id"] == linked["node"], "left").select("id", "k1", "k2", "set_id", F.coalesce("root", "set_id").alias("root"))


def keep_one_copy(docs: DataFrame, size: int = COPY_SHINGLE, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one document of each component of near_copies: the one of least id stays (null last; ties by digests of the text)."""
    return one_of_each(docs, near_copies(docs, size, id_col, text_col, **options), id_col, text_col)
