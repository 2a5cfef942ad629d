"""Repeated passages of words by recompression.

In a round, runs of equal symbols become one symbol, and then pairs: the alphabet
is parted into left and right symbols, and a left one before a right one becomes
one with it. A name follows from what it stands for and from nothing else, so all
tasks name equal runs and pairs alike, wherever they stand. Which symbols near the
ends of a passage are joined depends on what stands around it, but all symbols
farther inside follow from the passage alone: a run at an end goes, then a right
symbol at the left end and a left one at the right end, and so on in each round.

So each window of WINDOW words has interior symbols that all its occurrences
share. The longest of the last round that has any is the window's anchor; a
window without any, say, of two long runs, has its own name for it. Neighbouring
windows of one anchor form a segment. Segments meet by their anchors, once: equal
ones of later documents go as they are, and where segments of one anchor differ,
their windows are compared by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hot_keys, materialize, salted_join, small_batches, spark_of

#: Of a window of 13 words one round leaves some eight symbols inside, a second some three: then anchors change more often, and half as many segments more have to meet.
WINDOW = 13
ROUNDS = 1
#: Windows that are named at once; windows of a segment at most.
CHUNK = 1 << 16
SEGMENT_WINDOWS = 256
#: Least share of the texts, and least number, whose anchors are counted to find those with more than HOT_SEGMENTS segments and a HOT_ANCHORS-th of all.
SAMPLE_SHARE = 1 / 16
SAMPLE_DOCS = 4_000
HOT_SEGMENTS = 200
HOT_ANCHORS = 2_000
#: Different words whose names a task keeps.
KNOWN_WORDS = 1_000_000
#: Ids count as this if they are null: none is larger.
LAST_ID = (1 << 63) - 1

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Splits up near values: a permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Names(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = name = xxhash.xxh3_64_intdigest(word)
        return name


def split(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_names(x: np.ndarray, window: int, factor: np.uint64) -> np.ndarray:
    n = len(x) - window + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        out *= factor
        out += x[i : i + n]
    return mixed(out)


def _largest(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest of keys[lo:hi], range by range; none is empty."""
    out = np.zeros(len(lo), dtype=np.uint64)
    if not len(lo):
        return out
    step = np.frexp(hi - lo)[1] - 1  # power of two in each width
    best, width = keys, 1
    for power in range(int(step.max()) + 1):
        at = np.flatnonzero(step == power)
        out[at] = np.maximum(best[lo[at]], best[hi[at] - width])
        if len(best) > width:
            best, width = np.maximum(best[:-width], best[width:]), width * 2
    return out


def anchors(x: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its first word, its number of words) of each window of the names x, the same for equal windows in any surroundings.

    Of several equal symbols the first in the window counts. Windows without an
    interior have themselves as anchor; their first word is told as -1.
    """
    out = window_names(x, window, _A)
    at, words = np.full(len(out), -1, dtype=np.int64), np.full(len(out), window, dtype=np.int64)
    live = np.arange(len(out))
    lo, hi = live, live + window
    begin, width = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    for round_ in range(rounds):
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        count = np.diff(np.append(first, len(x)))
        run = np.repeat(np.arange(len(first)), count)
        lo, hi = run[lo] + 1, run[hi - 1]
        x = np.where(count > 1, mixed(x[first] + _A * count.astype(np.uint64)), x[first])
        begin, width = begin[first], np.add.reduceat(width, first)
        inside = lo < hi
        live, lo, hi = live[inside], lo[inside], hi[inside]
        right = mixed(x ^ mixed(np.full(1, round_ + 1, dtype=np.uint64))) >> np.uint64(63) == 1
        lo, hi = lo + right[lo], hi - ~right[hi - 1]
        inside = lo < hi
        live, lo, hi = live[inside], lo[inside], hi[inside]
        starts = np.ones(len(x), dtype=bool)
        starts[1:] = ~right[1:] | right[:-1]
        number = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        paired = np.diff(np.append(first, len(x))) == 2
        joined = x[first]
        joined[paired] = mixed(joined[paired] * _A + mixed(x[first[paired] + 1]))
        begin, width = begin[first], np.add.reduceat(width, first)
        lo, hi = number[lo], number[hi - 1] + 1
        x = joined
        # longer symbols are larger, so they are anchors before shorter ones
        keys = (np.minimum(width, 63).astype(np.uint64) << np.uint64(58)) | (mixed(x ^ _C) >> np.uint64(6))
        best = _largest(keys, lo, hi)
        place, open_ = lo.copy(), np.flatnonzero(keys[lo] != best)
        while len(open_):  # on to the first that is the largest; there is one
            place[open_] += 1
            open_ = open_[keys[place[open_]] != best[open_]]
        out[live], at[live], words[live] = best, begin[place], width[place]
    return out, at, words


def _sides(x: np.ndarray, at: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Names of 32 bits of the words left and right of anchors, as one number each. lo, hi: edges of the anchors' texts.

    A window has half of its other words on one side of its anchor at least, so
    segments that share one are named alike on that side. A side without so
    many words is named by its place.
    """
    need = np.maximum((window - words + 1) // 2, 0)
    left, right = (mixed(at.astype(np.uint64) ^ f) for f in (_A, _C))
    for k in np.unique(need):
        own = np.flatnonzero(need == k)
        for names, first in ((left, at[own] - k), (right, at[own] + words[own])):
            ok = (first >= lo[own]) & (first + k <= hi[own])
            total = np.zeros(int(ok.sum()), dtype=np.uint64)
            for i in range(int(k)):
                total = (total + x[first[ok] + i]) * _B
            names[own[ok]] = mixed(total)
    return (left & ~np.uint64(0xFFFFFFFF)) | (right >> np.uint64(32))


def segments(texts: list[list[bytes]], window: int, names: Names, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(anchor, text, first window, number of windows, content, sides) of the segments of texts in words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x = np.fromiter((names[w] for t in texts for w in t), dtype=np.uint64, count=int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    end = np.cumsum(sizes)
    begin = end - sizes
    power = np.cumprod(np.full(SEGMENT_WINDOWS, _B, dtype=np.uint64))
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(x) - window + 1, CHUNK):
        part = x[s : s + CHUNK + window - 1]
        n = len(part) - window + 1
        own = text[s : s + n]
        (anchor, at, words), whole = anchors(part, window, rounds), window_names(part, window, _C)
        ok = own == text[s + window - 1 : s + window - 1 + n]  # no window reaches over two texts
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (ok[1:] != ok[:-1]))))
        count = np.diff(np.append(first, n))
        if count.max() > SEGMENT_WINDOWS:
            pieces = -(-count // SEGMENT_WINDOWS)
            inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + SEGMENT_WINDOWS * inside
            count = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, count)
        content = np.add.reduceat(whole * power[place], first) ^ (count.astype(np.uint64) * _A)
        ok = ok[first]
        first, count, content = first[ok], count[ok], content[ok]
        doc = own[first]
        # windows that are their own anchors have no sides: all are alike
        sides = np.zeros(len(first), dtype=np.uint64)
        known = np.flatnonzero(at[first] >= 0)
        sides[known] = _sides(x, s + at[first[known]], words[first[known]], begin[doc[known]], end[doc[known]], window)
        found.append((anchor[first], doc, s + first - begin[doc], count, content, sides))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _counted(frames: Iterator[pd.DataFrame], window: int, rounds: int) -> Iterator[pd.DataFrame]:
    """The anchors of a batch and how many segments they have."""
    names = Names()
    for frame in frames:
        anchor, *_ = segments([split(t) for t in frame["text"]], window, names, rounds)
        a, n = np.unique(anchor, return_counts=True)
        yield pd.DataFrame({"a": a.view(np.int64), "n": n})


def hot_anchors(texts: DataFrame, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors that hold a large share of the segments of a sample of texts, HOT_ANCHORS at most, and over how many salts to spread each.

    They decide where segments meet, never what is found.
    """
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, texts.count())))
    keys = texts.select("text").sample(share, seed=42).mapInPandas(lambda it: _counted(it, window, rounds), "a long, n long")
    counts = keys.groupBy("a").agg(F.sum("n").alias("n"))
    most = max(HOT_SEGMENTS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_ANCHORS)
    hot = counts.where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("salts")).orderBy("a").toPandas()
    return hot["a"].to_numpy(dtype=np.int64), hot["salts"].to_numpy(dtype=np.int32)


def _placed(frames: Iterator[pd.DataFrame], window: int, rounds: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[pd.DataFrame]:
    """The segments of texts: place is first window * 512 + number of windows; salt is 0 if the anchor isn't hot.

    Segments that repeat one of a smaller id in their batch are settled: they
    need to meet no other, so their anchor is replaced by a name of their own.
    """
    names = Names()
    anchors_, salts = hot
    for frame in frames:
        anchor, text, at, n, content, sides = segments([split(t) for t in frame["text"]], window, names, rounds)
        if not len(anchor):
            continue
        ids, digests = (frame[c].to_numpy()[text] for c in ("id", "digest"))
        a, c = anchor.view(np.int64), content.view(np.int64)
        salt = np.zeros(len(a), dtype=np.int32)
        if len(anchors_):
            where = np.minimum(np.searchsorted(anchors_, a), len(anchors_) - 1)
            spread = np.flatnonzero(anchors_[where] == a)
            salt[spread] = 1 + (content[spread] % salts[where[spread]].astype(np.uint64)).astype(np.int32)
        order = np.lexsort((ids, c, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])))
        least = np.empty(len(a), dtype=np.int64)
        least[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        settled = ids > least
        a = np.where(settled, mixed((ids.astype(np.uint64) << np.uint64(32)) ^ at.astype(np.uint64)).view(np.int64), a)
        salt[settled] = -1
        yield pd.DataFrame({"a": a, "salt": salt, "c": c, "id": ids, "digest": digests, "place": at * 512 + n, "sides": sides.view(np.int64)})


def _windows(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Names of the windows of the wanted segments; `later`: the anchor stands in a document before."""
    names = Names()
    for frame in frames:
        out = []
        for i, digest, text, wants in zip(frame["id"], frame["digest"], frame["text"], frame["wants"], strict=True):
            words = split(text)
            x = np.fromiter((names[w] for w in words), dtype=np.uint64, count=len(words))
            later = np.zeros(max(0, len(x) - window + 1), dtype=np.int8)
            for w in wants:
                at = slice(w["at"], w["at"] + w["n"])
                later[at] = np.maximum(later[at], 2 if w["later"] else 1)
            at = np.flatnonzero(later)
            for s in range(0, len(at), CHUNK):
                near = at[s : s + CHUNK]
                lo, hi = near[0], near[-1] + window
                p, q = (window_names(x[lo:hi], window, f)[near - lo].view(np.int64) for f in (_A, _C))
                out.append(pd.DataFrame({"p": p, "q": q, "id": i, "digest": digest, "at": near.astype(np.int32), "later": later[near] == 2}))
        if out:
            yield pd.concat(out, ignore_index=True)


def repeated_spans(texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """id, digest, spans: array of (at, n), the windows (first one, how many) of texts (id, digest, text) that also start in a text of a smaller id."""
    spark = spark_of(texts)
    small_batches(spark, 250)
    hot = hot_anchors(texts, window, rounds)
    rows = texts.mapInPandas(lambda it: _placed(it, window, rounds, hot), "a long, salt int, c long, id long, digest int, place long, sides long")
    # one exchange by anchor serves both: the segments of an anchor (or of a salt of it), and of those the equal ones
    anchor, equal = Window.partitionBy("a", "salt"), Window.partitionBy("a", "salt", "c")
    met = rows.withColumns({"low": F.min("id").over(anchor), "first": F.min("id").over(equal), "left": F.shiftright("sides", 32), "right": F.col("sides").bitwiseAND(0xFFFFFFFF)})
    # only different contents that are alike on a side of the anchor can share a window
    differs = [F.min("c").over(Window.partitionBy("a", "salt", side)) != F.max("c").over(Window.partitionBy("a", "salt", side)) for side in ("left", "right")]
    met = met.withColumn("several", differs[0] | differs[1])
    settled, repeat, salted = F.col("salt") < 0, F.col("id") > F.col("first"), F.col("salt") > 0
    # what salts of an anchor don't know of each other is left to its windows
    later = salted | (F.col("first") > F.col("low"))
    met = met.where(settled | repeat | salted | F.col("several"))
    span = F.struct(F.floor(F.col("place") / 512).cast("int").alias("at"), (F.col("place") % 512).cast("int").alias("n"))
    met = materialize(met.select("id", "digest", span.alias("span"), (settled | repeat).alias("whole"), later.alias("later")), "recompression-met")
    # segments of a later document are whole repeats; those of the first are compared window by window
    whole = met.where("whole").select("id", "digest", "span")
    edges = met.where("not whole").groupBy("id", "digest").agg(F.collect_list(F.struct("span.at", "span.n", "later")).alias("wants"))
    asked = texts.join(edges.hint("merge"), ["id", "digest"])
    windows = asked.select("id", "digest", "text", "wants").mapInPandas(lambda it: _windows(it, window), "p long, q long, id long, digest int, at int, later boolean")
    windows = materialize(windows, "recompression-windows")
    earlier = windows.groupBy("p", "q").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).where("low < high")
    earlier = materialize(earlier.select("p", "q", "low", "rows"), "recompression-earlier")
    late = salted_join(windows.where("later"), earlier.drop("rows"), ["p", "q"], hot_keys(earlier, ["p", "q"], "rows"), F.xxhash64("id", "at"))
    single = late.where("id > low").select("id", "digest", F.struct("at", F.lit(1).alias("n")).alias("span"))
    return whole.unionByName(single).groupBy("id", "digest").agg(F.collect_list("span").alias("spans"))


def cut(words: list[bytes], spans, window: int) -> tuple[str, int]:
    """The words outside the windows, joined by spaces, and how many are inside."""
    if spans is None or not len(spans):
        return b" ".join(words).decode("utf-8", "surrogatepass"), 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, [s["at"] for s in spans], 1)
    np.add.at(edges, [s["at"] + s["n"] + window - 1 for s in spans], -1)
    gone = np.cumsum(edges[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(kept).decode("utf-8", "surrogatepass"), len(words) - len(kept)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs with kept (the remaining words, joined by one space), n_words and n_removed.

    Each word goes that is covered by `window` consecutive words which also
    start in a document of a smaller id; windows are judged on the input and
    never reach over two documents. Words are runs without ASCII white space.
    The first document of a passage keeps it, however often it has it, and so do
    rows of one id among each other. A null id counts as the largest. Null texts
    and those without words have kept ""; texts of fewer words than a window
    lose none. An empty table gives no rows; clashing names of docs are
    replaced. Words are known by 64 bits, windows by 128.
    """
    base = docs.drop(*({"kept", "n_words", "n_removed"} & set(docs.columns)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    # where ids are all different, they tell the texts apart
    repeated = docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    digest = (F.crc32(text.cast("binary")) - (1 << 31)).cast("int") if repeated else F.lit(0)
    texts = docs.select(key.alias("id"), digest.alias("digest"), text.alias("text"))
    spans = repeated_spans(texts, window, rounds).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def rest(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for own, all_spans in it:
            rows = []
            for t, s in zip(own, all_spans, strict=True):
                words = split(t)
                kept, gone = cut(words, s, window)
                rows.append((kept, len(words), gone))
            yield pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    joined = base.withColumns({"__id": key, "__digest": digest}).join(spans.hint("merge"), ["__id", "__digest"], "left")
    return joined.withColumn("__cut", rest(text, F.col("__spans"))).select(*[F.col(f"`{c}`") for c in base.columns], "__cut.kept", "__cut.n_words", "__cut.n_removed")


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, digest of what is kept) by counting every window in a dictionary: for tests."""
    first: dict[tuple[bytes, ...], int] = {}
    for i, text in rows:
        words, key = split(text), LAST_ID if i is None else i
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            first[own] = min(first.get(own, key), key)
    out = []
    for i, text in rows:
        words, key = split(text), LAST_ID if i is None else i
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < key:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


