"""Exact substring dedup: bytes covered by a long string that also starts elsewhere.

Every window of MIN_BYTES bytes has an anchor: the least hash of the short
strings inside it. Equal windows have equal anchors, so only documents that
share one have to meet. Neighbouring windows of one anchor form a segment; equal
segments are kept once, with a weight. Segments that share anchors are put
together in blocks, and on the Burrows-Wheeler transform of a block breadth-first
backward extension derives the common prefixes of neighbouring suffixes by
increasing value. It stops at MIN_BYTES: boundaries that are still open then part
no interval, and an interval of weight two or more is a repeated window.

An anchor with more different segments than a block takes is crowded, say, one at
the edge of a passage that very many documents hold. The windows of its segments
get anchors once more, from longer strings, which tell more of them apart; the
longest are whole windows, of which equal ones are one segment. So every window
goes through a transform, and no block grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hot_keys, materialize, salted_join, small_batches, spark_of

MIN_BYTES = 200
#: Length of the strings that anchors are chosen from, in eighths of a window: first for all texts, then for what is crowded.
ANCHOR_EIGHTHS = (2, 5, 7, 8)
#: Windows of a segment at most; longer runs of one anchor are cut.
SEGMENT_WINDOWS = 4096
#: Bytes of a block, give or take one group.
BLOCK_BYTES = 1_500_000
#: Different segments of one anchor that a block takes; of larger groups, the windows get longer anchors.
GROUP_SEGMENTS = 2048

_MULTIPLIER, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_CHUNK = 1 << 18


def _powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(multiplier, -1, 1 << 64)
    up, down = (np.full(n, x, dtype=np.uint64) for x in (multiplier, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(b: np.ndarray, k: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """64-bit hashes of all strings of k bytes of b, the same wherever they stand."""
    n = len(b) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if multiplier not in _TABLES:
        _TABLES[multiplier] = _powers(multiplier, _CHUNK + MIN_BYTES * 8)
    up, down = _TABLES[multiplier]
    out = np.empty(n, dtype=np.uint64)
    for s in range(0, n, _CHUNK):
        part = b[s : s + _CHUNK + k - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[s : s + m] = (sums[k:] - sums[:m]) * down[:m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _slide(f, x: np.ndarray, span: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over all runs of span neighbours of x."""
    width = 1
    while width * 2 <= span:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: -(span - width)], x[span - width :]) if span > width else x


def _anchored(text: bytes, length: int, anchor: int, cut: int) -> tuple[np.ndarray, ...]:
    """(anchor hash of every window, first window, number of windows, whether the anchor stands in it twice) of the segments of a text."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) < length:
        z = np.empty(0, dtype=np.int64)
        return z.view(np.uint64), z, z, z.astype(bool)
    hashes, span = rolling(b, anchor), length - anchor + 1
    least = _slide(np.minimum, hashes, span)
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(change, len(least)))
    # the places that are least somewhere come in the order of the segments they are least in
    edge = np.zeros(span - 1, dtype=np.uint64)
    places = hashes[hashes == _slide(np.maximum, np.concatenate((edge, least, edge)), span)]
    again = np.diff(np.append(np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))), len(places))) > 1
    if size.max() > cut:
        pieces = -(-size // cut)
        again = np.repeat(again, pieces)
        # the pieces of a segment start at its first window and every `cut` windows on
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        change = np.repeat(change, pieces) + cut * inside
        size = np.diff(np.append(change, len(least)))
    return least, change, size, again


def segments(text: bytes, length: int = MIN_BYTES, anchor: int = MIN_BYTES // 4, cut: int = SEGMENT_WINDOWS) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, number of windows) of the segments of a text."""
    least, change, size, _ = _anchored(text, length, anchor, cut)
    if not len(least):
        return least, least, change, size
    whole = rolling(np.frombuffer(text, dtype=np.uint8), length)
    if -1 not in _TABLES:
        _TABLES[-1] = _powers(_SECOND, SEGMENT_WINDOWS + 1)
    inside = np.arange(len(least)) - np.repeat(change, size)
    content = np.add.reduceat(whole * _TABLES[-1][0][inside], change) ^ (size.astype(np.uint64) * np.uint64(_MULTIPLIER))
    return least[change], content, change, size


def suffix_order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Positions of sym (uint8) in order of the strings that start there, told apart up to depth symbols or more."""
    n = len(sym)
    padded = np.concatenate((sym, np.zeros(8, dtype=np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1], [True]))
    rank = np.zeros(n + 1, dtype=np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(first[:-1], slots, 0)) + 1
    done = 8
    while done < depth:
        tied = np.flatnonzero(~(first[:-1] & first[1:]))
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + done, n)].astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        first[tied[1:]] |= key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(first[tied], tied, 0)) + 1
        done *= 2
    return order


def common_prefixes(sym: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """lcp[i]: common prefix of the suffixes in slots i - 1 and i where it is below limit, else -1.

    Symbol 0 parts texts: no string is extended backwards over it, so values
    hold for suffixes whose prefix below limit has none. Intervals of strings
    one symbol longer come from the symbols before the suffixes of an interval;
    one is followed only if it is the first to end at its boundary.
    """
    n = len(sym)
    bwt = sym[order - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[by] = np.arange(n)
    same = bwt[by[1:]] == bwt[by[:-1]]
    following, preceding = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    following[by[:-1][same]] = by[1:][same]
    preceding[by[1:][same]] = by[:-1][same]
    lcp = np.full(n + 1, -1, dtype=np.int16)
    counts = np.bincount(sym, minlength=256)
    ends = np.cumsum(counts)
    present = counts > 0
    lo, hi = (ends - counts)[present], ends[present] - 1
    lcp[0] = lcp[n] = 0
    lcp[hi + 1] = 0
    for value in range(1, limit):
        if not len(lo):
            break
        size = hi - lo + 1
        member = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        extends = bwt[member] != 0
        last = member[extends & (following[member] > np.repeat(hi, size))]
        first = member[extends & (preceding[member] < np.repeat(lo, size))]
        hi, lo = np.sort(lf[last]), np.sort(lf[first])  # intervals of one length are disjoint: sorted ends belong together
        new = lcp[hi + 1] < 0
        hi, lo = hi[new], lo[new]
        lcp[hi + 1] = value
    return lcp


def repeated_windows(texts: list[bytes], weights: list[np.ndarray], length: int = MIN_BYTES) -> list[np.ndarray]:
    """Per text, for every byte: does the window of `length` bytes that starts there have a weight of two or more in all texts?"""
    sizes = np.array([len(t) for t in texts])
    sym = np.zeros(int(sizes.sum()) + len(texts), dtype=np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    weight = np.zeros(len(sym))
    for s, t, w in zip(starts, texts, weights, strict=True):
        sym[s : s + len(t)] = np.minimum(np.frombuffer(t, dtype=np.uint8), 254) + 1
        weight[s : s + len(t)] = w
    order = suffix_order(sym, length)
    lcp = common_prefixes(sym, order, length)
    interval = np.cumsum(lcp[:-1] >= 0) - 1
    heavy = np.bincount(interval, weights=weight[order])[interval] >= 2
    found = np.zeros(len(sym), dtype=bool)
    found[order] = heavy
    out = []
    for s, n in zip(starts, sizes, strict=True):
        mask = found[s : s + n].copy()
        mask[max(0, n - length + 1) :] = False
        out.append(mask)
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchor_keys(frames: Iterator[pd.DataFrame], length: int, anchor: int, cut: int) -> Iterator[pd.DataFrame]:
    """The anchors alone, one row per segment; those that stand in a segment twice count as two."""
    for frame in frames:
        parts = [_anchored(t, length, anchor, cut) for t in frame["text"]]
        n = [len(p[1]) for p in parts]
        if sum(n):
            weight = np.repeat(frame["weight"].to_numpy(), n)
            again = np.concatenate([p[3] for p in parts])
            yield pd.DataFrame({"h": np.concatenate([p[0][p[1]] for p in parts]).view(np.int64), "k1": np.repeat(frame["k1"].to_numpy(), n), "times": np.where(again, 2, weight)})


def _anchor_rows(frames: Iterator[pd.DataFrame], length: int, anchor: int, cut: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parts = [segments(t, length, anchor, cut) for t in frame["text"]]
        n = [len(p[0]) for p in parts]
        if sum(n):
            h, content, lo, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            k1, k2, weight = (np.repeat(frame[c].to_numpy(), n) for c in ("k1", "k2", "weight"))
            yield pd.DataFrame({"h": h.view(np.int64), "content": content.view(np.int64), "k1": k1, "k2": k2, "lo": lo.astype(np.int64), "n": size.astype(np.int32), "weight": weight})


def _regions(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Texts of the wanted segments; neighbouring ones of a document that go to the same block are one region."""
    for frame in frames:
        rows: list[tuple] = []
        for k1, k2, text, wants in zip(frame["k1"], frame["k2"], frame["text"], frame["wants"], strict=True):
            wants = sorted((w["family"], w["part"], w["lo"], w["n"], w["h"], w["content"], w["weight"]) for w in wants)
            i = 0
            while i < len(wants):
                family, part, lo = wants[i][:3]
                end, j = lo, i
                while j < len(wants) and wants[j][:2] == (family, part) and wants[j][2] <= end:
                    end = max(end, wants[j][2] + wants[j][3] + length - 1)
                    j += 1
                own = wants[i:j]
                rows.append((family, part, k1, k2, lo, text[lo:end], [w[2] for w in own], [w[3] for w in own], [w[4] for w in own], [w[5] for w in own], [w[6] for w in own]))
                i = j
        yield pd.DataFrame(rows, columns=["family", "part", "k1", "k2", "lo", "bytes", "at", "n", "h", "content", "weight"])


def _block_results(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = rows.sort_values(["k1", "k2", "lo"], kind="stable")
    texts: list[bytearray] = []
    heads: list[tuple] = []
    own: list[list[int]] = []
    for i, (k1, k2, lo, text) in enumerate(zip(rows["k1"], rows["k2"], rows["lo"], rows["bytes"], strict=True)):
        if heads and heads[-1][:2] == (k1, k2) and lo <= heads[-1][2] + len(texts[-1]):
            known = heads[-1][2] + len(texts[-1]) - lo
            texts[-1] += text[known:] if known < len(text) else b""
            own[-1].append(i)
        else:
            heads.append((k1, k2, lo))
            texts.append(bytearray(text))
            own.append([i])
    cols = {c: rows[c].tolist() for c in ("at", "n", "h", "content", "weight")}
    weights = []
    for head, text, ids in zip(heads, texts, own, strict=True):
        w = np.ones(len(text))
        for i in ids:
            for at, n, x in zip(cols["at"][i], cols["n"][i], cols["weight"][i], strict=True):
                w[at - head[2] : at - head[2] + n] = x
        weights.append(w)
    out: list[tuple] = []
    for head, mask, ids in zip(heads, repeated_windows([bytes(t) for t in texts], weights, length), own, strict=True):
        upto = np.concatenate(([0], np.cumsum(mask)))
        for i in ids:
            for at, n, h, content in zip(cols["at"][i], cols["n"][i], cols["h"][i], cols["content"][i], strict=True):
                a = at - head[2]
                found = upto[a + n] - upto[a]
                if found == n:
                    out.append((h, content, [0], [n]))
                elif found:
                    s, e = _runs(mask[a : a + n])
                    out.append((h, content, s.tolist(), e.tolist()))
    return pd.DataFrame(out, columns=["h", "content", "starts", "ends"])


def _blocks(frames: Iterator[pd.DataFrame], length: int, block_bytes: int) -> Iterator[pd.DataFrame]:
    """Regions come in order of (family, part); a block takes whole groups of these."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        group = (frame["family"] != frame["family"].shift()) | (frame["part"] != frame["part"].shift())
        if held and (held[-1]["family"].iloc[-1], held[-1]["part"].iloc[-1]) == (frame["family"].iloc[0], frame["part"].iloc[0]):
            group.iloc[0] = False
        for _, piece in frame.groupby(group.cumsum(), sort=False):
            if size >= block_bytes and group.loc[piece.index[0]]:
                yield _block_results(pd.concat(held, ignore_index=True), length)
                held, size = [], 0
            held.append(piece)
            size += sum(map(len, piece["bytes"]))
    if held:
        yield _block_results(pd.concat(held, ignore_index=True), length)


def _crowd_texts(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The bytes of the segments of crowded anchors, as texts known by (h, content)."""
    for frame in frames:
        rows = [(w["h"], w["content"], w["weight"], text[w["lo"] : w["lo"] + w["n"] + length - 1]) for text, wants in zip(frame["text"], frame["wants"], strict=True) for w in wants]
        yield pd.DataFrame(rows, columns=["k1", "k2", "weight", "text"])


def _repeated(texts: DataFrame, length: int, anchors: tuple[int, ...], group_segments: int, block_bytes: int) -> DataFrame:
    """k1, k2, windows: array of (starts, ends), the runs of repeated windows of texts (k1, k2, weight, text: binary), by their first bytes.

    anchors: lengths of the strings that anchors are chosen from, the last that
    of a window. Rows of equal keys are copies and add their weights.
    """
    anchor, rest = anchors[0], anchors[1:]
    cut = SEGMENT_WINDOWS if rest else 1
    keys = texts.select("k1", "weight", "text").mapInPandas(lambda it: _anchor_keys(it, length, anchor, cut), "h long, k1 long, times long")
    # an anchor matters that stands in two places, be it in one segment
    shared = keys.groupBy("h").agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min("k1").alias("family")).where("times > 1")
    shared = materialize(shared.select("h", "family", "rows"), "suffix-shared")
    rows = texts.select("k1", "k2", "weight", "text").mapInPandas(lambda it: _anchor_rows(it, length, anchor, cut), "h long, content long, k1 long, k2 long, lo long, n int, weight long")
    members = salted_join(rows, shared.drop("rows"), ["h"], hot_keys(shared, ["h"], "rows"), F.xxhash64("k1", "lo"))
    members = materialize(members.groupBy("h", "content", "k1", "k2", "lo", "n", "family").agg(F.sum("weight").alias("copies")), "suffix-members")
    segment = members.groupBy("h", "content", "family").agg(F.sum("copies").alias("weight"), F.count("*").alias("rows"), F.min(F.struct("k1", "k2", "lo", "n")).alias("rep"))
    segment = materialize(segment.select("h", "content", "family", "weight", "rows", "rep.*"), "suffix-segments")
    per = segment.groupBy("h", "family").agg(F.count("*").alias("different"), F.sum(F.col("n") + length - 1).alias("bytes"))
    crowded = materialize(per.where(F.lit(bool(rest)) & (F.col("different") > group_segments)), "suffix-crowded")
    none = crowded.limit(1).count() == 0
    # a family's segments lie around the anchors of one text; large families are cut by anchor
    families = per.where(F.lit(not rest) | (F.col("different") <= group_segments)).groupBy("family").agg(F.sum("different").alias("different"), F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("parts"))
    families = materialize(families.where("parts > 1"), "suffix-families")
    placed = segment
    if none:
        placed = placed.withColumn("crowded", F.lit(False))
    else:
        flag = crowded.select("h", F.lit(True).alias("flag"))
        placed = salted_join(placed, flag, ["h"], hot_keys(crowded, ["h"], "different"), F.col("content"), "left").withColumn("crowded", F.coalesce("flag", F.lit(False))).drop("flag")
    placed = salted_join(placed, families.select("family", "parts"), ["family"], hot_keys(families, ["family"], "different"), F.col("content"), "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h"), F.coalesce("parts", F.lit(1))).cast("int"))
    # copies of a text are equal, so any one will do
    one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    want = F.struct("family", "part", "lo", "n", "h", "content", "weight")
    wants = placed.groupBy("k1", "k2").agg(F.collect_list(F.when(~F.col("crowded"), want)).alias("wants"), F.collect_list(F.when(F.col("crowded"), want)).alias("crowds"))
    sources = one.join(wants.hint("merge"), ["k1", "k2"])
    if not none:
        sources = materialize(sources, "suffix-sources")
    regions = sources.select("k1", "k2", "text", "wants").where(F.size("wants") > 0)
    array = "array<long>"
    regions = regions.mapInPandas(lambda it: _regions(it, length), f"family long, part int, k1 long, k2 long, lo long, bytes binary, at {array}, n {array}, h {array}, content {array}, weight {array}")
    regions = regions.repartition("family", "part").sortWithinPartitions("family", "part")
    found = regions.mapInPandas(lambda it: _blocks(it, length, block_bytes), "h long, content long, starts array<long>, ends array<long>")
    found = materialize(found.select("h", "content", F.arrays_zip("starts", "ends").alias("windows")), "suffix-found")
    if not none:
        single = sources.select("text", F.col("crowds").alias("wants")).where(F.size("wants") > 0)
        crowd = materialize(single.mapInPandas(lambda it: _crowd_texts(it, length), "k1 long, k2 long, weight long, text binary"), "suffix-crowd")
        more = _repeated(crowd, length, rest, group_segments, block_bytes)
        found = found.unionByName(more.select(F.col("k1").alias("h"), F.col("k2").alias("content"), "windows"))
    at = members.select("h", "content", "k1", "k2", "lo")
    spans = salted_join(at, found, ["h", "content"], hot_keys(segment, ["h", "content"], "rows"), F.xxhash64("k1", "lo"))
    shifted = F.transform("windows", lambda w: F.struct((F.col("lo") + w["starts"]).alias("starts"), (F.col("lo") + w["ends"]).alias("ends")))
    return spans.select("k1", "k2", shifted.alias("windows")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def repeated_spans(docs: DataFrame, length: int = MIN_BYTES, text_col: str = "text", group_segments: int = GROUP_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """k1, k2 (digests of a text), spans: array of (start, end) in bytes, which may overlap, whose union is to go.

    One row per different text with a repeated window. Rows with equal texts
    are different documents: they repeat each other.
    """
    small_batches(spark_of(docs), 250)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.lit(1).cast("long").alias("weight"), text.cast("binary").alias("text"))
    anchors = tuple(max(1, length * e // 8) for e in ANCHOR_EIGHTHS)
    found = _repeated(texts, length, anchors, group_segments, block_bytes)
    return found.select("k1", "k2", F.transform("windows", lambda w: F.struct(w["starts"].alias("start"), (w["ends"] + (length - 1)).alias("end"))).alias("spans"))


def _cut(text: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    if spans is None or not len(spans):
        return text, 0
    at = np.sort(np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64).view("i8,i8"), axis=0).view(np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(at[:, 1])
    new = np.concatenate(([True], at[1:, 0] > reach[:-1]))
    starts, ends = at[new, 0], np.append(reach[:-1][new[1:]], reach[-1])
    kept = [text[a:b] for a, b in zip(np.append(0, ends), np.append(starts, len(text)), strict=True)]
    return b"".join(kept), len(starts)


def dedup_substrings(docs: DataFrame, length: int = MIN_BYTES, text_col: str = "text", **options) -> DataFrame:
    """docs with kept (the remaining bytes, binary), n_bytes, n_removed, n_spans.

    Each byte goes that a string of `length` bytes covers which also starts
    anywhere else, in the same document or another; strings are judged on the
    input and never reach over two documents. Null texts are empty: nothing
    goes. Rows with equal texts repeat each other, so repeated rows lose all of
    a text of `length` bytes or more. Ids are not read; an empty table gives no
    rows; clashing names of docs are replaced.
    """
    base = docs.drop(*({"kept", "n_bytes", "n_removed", "n_spans"} & set(docs.columns)))
    spans = repeated_spans(base, length, text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = base.select("*", F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"))
    spans = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    copies = materialize(keyed.groupBy("__k1", "__k2").agg(F.count("*").alias("rows")).where("rows > 1"), "suffix-copies")

    @F.pandas_udf("kept binary, n_spans long")
    def cut(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in it:
            yield pd.DataFrame([_cut(t, s) for t, s in zip(texts, all_spans, strict=True)], columns=["kept", "n_spans"])

    told = [F.col(f"`{c}`") for c, kind in base.dtypes if c != text_col and "map<" not in kind and "variant" not in kind]
    spread = F.xxhash64(*told) if told else F.lit(0)
    joined = salted_join(keyed, spans, ["__k1", "__k2"], hot_keys(copies, ["__k1", "__k2"], "rows"), spread, "left").withColumn("__cut", cut(text.cast("binary"), F.col("__spans")))
    n = F.octet_length(text).cast("long")
    out = joined.select(*[F.col(f"`{c}`") for c in base.columns], F.col("__cut.kept").alias("kept"), n.alias("n_bytes"), (n - F.octet_length("__cut.kept")).cast("long").alias("n_removed"), F.col("__cut.n_spans").alias("n_spans"))
    return out


def brute_force(texts: list[bytes], length: int = MIN_BYTES) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, digest of what is kept) by counting every window in a dictionary: for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append((int(mask.sum()), len(_runs(mask)[0]), hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~mask].tobytes()).hexdigest()))
    return out
