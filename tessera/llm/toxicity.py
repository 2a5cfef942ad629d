"""Toxicity by two class-conditional Kneser-Ney models.

The models run over the bytes of words, so that endings and spellings that were
not learned are judged by their parts. The highest order is counted per class;
all below it is one set of continuation counts that both classes share. So an
expression that is rare in both is equally likely in both and says nothing. The
two log-likelihoods, normalised by length, are compared; a logistic function
makes the score, fitted on training documents by counts from the other folds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, spark_of

FOLDS = 5
HELD_OUT = 0
#: Labelled documents of each class that counts and fit take at most: those of least digest of their ids.
SAMPLE_DOCS = 6000
ORDER = 4
CACHE_ENTRIES = 400_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(word: bytes, order: int = ORDER) -> list[bytes]:
    """The n-grams of a word: each byte, and the end, after up to order - 1 bytes before it; a space stands before and after the word."""
    padded = b" " + word + b" "
    return [padded[max(0, i - order + 1) : i + 1] for i in range(1, len(padded))]


def word_ratio(model: dict[bytes, float], word: bytes, order: int = ORDER) -> float:
    total = 0.0
    for w in windows(word, order):
        x = model.get(w)
        if x is None:
            x = model.get(b"\xff" + w[:-1], 0.0)  # the context alone: both classes back off
        total += x
    return total


def train(counts: dict[bytes, tuple[int, int]], order: int = ORDER) -> dict[bytes, float]:
    """log p(toxic) - log p(ordinary) of every n-gram counted, and, under 0xFF and a context, of all that were not.

    counts: n-gram to its counts in ordinary and in toxic texts.
    """
    # shared continuation counts: in how many different contexts one byte longer a shorter n-gram stands
    shared: list[Counter] = [Counter() for _ in range(order)]
    level: set[bytes] = set(counts)
    done: set[bytes] = set()  # the ends of words reach a length by several ways, and count once
    for _ in range(order - 1):
        shorter = {w for w in level if len(w) > 1} - done
        done |= shorter
        below: set[bytes] = set()
        for w in shorter:
            shared[len(w) - 1][w[1:]] += 1
            below.add(w[1:])
        level = below
    merged: Counter = Counter()
    for c in shared:
        merged.update(c)
    ones, twos = (sum(1 for v in merged.values() if v == k) for k in (1, 2))
    drop = ones / (ones + 2 * twos) if ones and twos else 0.5
    total: Counter = Counter()
    kinds: Counter = Counter()
    for w, v in merged.items():
        total[w[:-1]] += v
        kinds[w[:-1]] += 1

    def lower(w: bytes) -> float:
        """Shared probability of the last byte of w after the rest."""
        context = w[:-1]
        below = lower(w[1:]) if context else 1 / 256
        if not total[context]:
            return below
        return (max(merged[w] - drop, 0) + drop * kinds[context] * below) / total[context]

    sums, seen = ([Counter(), Counter()] for _ in range(2))
    singles, doubles = [0, 0], [0, 0]
    for w, c in counts.items():
        for k in (0, 1):
            if c[k]:
                sums[k][w[:-1]] += c[k]
                seen[k][w[:-1]] += 1
                singles[k] += c[k] == 1
                doubles[k] += c[k] == 2
    discount = [singles[k] / (singles[k] + 2 * doubles[k]) if singles[k] and doubles[k] else 0.5 for k in (0, 1)]
    known: dict[bytes, float] = {}

    def rest(k: int, context: bytes) -> float:
        return discount[k] * seen[k][context] / sums[k][context] if sums[k][context] else 1.0

    out: dict[bytes, float] = {}
    for w, c in counts.items():
        context = w[:-1]
        below = known.setdefault(w[1:], lower(w[1:]) if len(w) > 1 else 1 / 256)
        p = [(max(c[k] - discount[k], 0) / sums[k][context] if c[k] else 0.0) + rest(k, context) * below for k in (0, 1)]
        out[w] = math.log(p[1] / p[0])
    for context in set(sums[0]) | set(sums[1]):
        out[b"\xff" + context] = math.log(rest(1, context) / rest(0, context))
    return out


@dataclass
class Scorer:
    """The log-ratios of n-grams and the logistic function over a text's two normalised differences."""

    model: dict[bytes, float]
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    order: int = ORDER
    seen: dict[bytes, float] = field(default_factory=dict, repr=False)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """1, the difference of the log-likelihoods per word, and the same per root of words; a few words are added so that short texts claim less."""
        total, own = 0.0, words(text)
        for w in own:
            x = self.seen.get(w)
            if x is None:
                x = word_ratio(self.model, w, self.order)
                if len(self.seen) >= CACHE_ENTRIES:
                    self.seen.clear()
                if len(w) <= 64:
                    self.seen[w] = x
            total += x
        n = len(own) + 8
        return 1.0, 10 * total / n, total / math.sqrt(n)

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A Scorer from the labelled documents outside the held-out fold.

    Repeated labels of an id count as toxic if one is; null ids and labels are
    left out. At most sample_docs documents of each class are read.
    """
    spark = spark_of(docs)
    small_batches(spark)
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("fold", fold).where(F.col("fold") != HELD_OUT)
    per_class = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for y in (0, 1)]
    sample = per_class[0].union(per_class[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, bytes], list[int]] = {}
        for frame in frames:
            for (fold, y), part in frame.groupby(["fold", "y"]):
                for w, n in Counter(w for t in part["text"] for w in words(t)).items():
                    for g in windows(w):
                        counts.setdefault((fold, g), [0, 0])[int(y)] += n
        yield pd.DataFrame([(f, g, *c) for (f, g), c in counts.items()], columns=["fold", "gram", "c0", "c1"])

    counted = texts.select("text", "y", F.col("fold").cast("int").alias("fold")).mapInPandas(grams, "fold int, gram binary, c0 long, c1 long")
    # bounded by the sample: n-grams of its words, by fold
    table = counted.groupBy("fold", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()

    def model(without: int | None) -> dict[bytes, float]:
        own = table[table["fold"] != without].groupby("gram")[["c0", "c1"]].sum()
        if not own["c0"].sum() or not own["c1"].sum():
            return {}
        return train({bytes(g): (int(a), int(b)) for g, a, b in zip(own.index, own["c0"], own["c1"], strict=True)})

    whole = model(None)
    if not whole:
        return Scorer({})
    parts = spark.sparkContext.broadcast({f: model(f) for f in range(FOLDS) if f != HELD_OUT})

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {f: Scorer(m) for f, m in parts.value.items()}
        for frame in frames:
            rows = [(*own[f].features(t), int(y)) for t, y, f in zip(frame["text"], frame["y"], frame["fold"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "c", "y"])

    fit = texts.select("text", "y", F.col("fold").cast("int").alias("fold")).mapInPandas(measured, "a double, b double, c double, y int").toPandas()
    return Scorer(whole, fit_logistic(fit[["a", "b", "c"]].to_numpy(), fit["y"].to_numpy(dtype=float)))


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Held out, and never learned from: crc32(id as text) modulo FOLDS is
    HELD_OUT. Null and empty texts have the score of no evidence; a null id is
    not held out; without labels of both classes every score is 0.5. Repeated
    rows stay rows; an empty table gives none; other columns are not read.
    """
    scorer = learn(docs, labels, sample_docs, id_col, text_col, label_col)
    shared = spark_of(docs).sparkContext.broadcast((scorer.model, scorer.weights))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(*shared.value)
        for s in texts:
            yield pd.Series([own.score(t) for t in s], dtype="float64")

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    out = docs.select(F.col(id_col), held.alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
