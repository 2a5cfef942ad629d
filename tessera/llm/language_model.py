"""Language-model scores by deleted interpolation.

p(w | h) mixes the maximum-likelihood bigram, the maximum-likelihood unigram and
a uniform term. The weights depend on how often h was seen (buckets by powers of
two) and are learned by expectation-maximisation on counts held out from
training.

Counting and scoring work on blocks of documents, some MB of text each. Up to
RELAY_BLOCKS blocks of a task stand together in a relay, which merges their
different words and word pairs and asks for the corpus counts of these once;
questions go to buckets by hash, a bucket adds up what all relays have seen, and
the answers go back to the relays. So a common word is one entry of a relay, and
no table of the vocabulary is ever in one place. Messages are relays times
buckets, but never more than different entries of relays: the size of relays and
buckets is bounded by memory alone, so both are as large as a task can hold.
Words are known by 64-bit hashes, pairs by 48 bits inside a bucket.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, spark_of

FOLDS = 7
HELD_OUT = 2
#: Training documents of this remainder give the held-out counts for the weights.
TUNE = 3
BLOCK_TOKENS = 400_000
#: Blocks of a relay at most: 16 hold up to 6.4 million different pairs, 100 MB of hashes and counts.
RELAY_BLOCKS = 16
#: Entries that a bucket answers at most, on average; there are 2 ** k buckets.
BUCKET_ENTRIES = 1_000_000
#: Hash of the end of a text, which is also what stands before its first word.
END = 0x5DEECE66D1CE4E5B
#: Steps of the histogram of likelihood ratios, per power of two. A ratio is off by 9 % at most (2 ** (1 / 8)), up and down alike; weights are learned from these, scores use exact ratios.
STEPS = 4

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_P = 0x9E3779B97F4A7C15


def _table(base: int, n: int) -> np.ndarray:
    x = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x)


class _Powers:
    """base ** i for any i below 2 ** 32, from two small tables."""

    def __init__(self, base: int):
        self.low, self.high = _table(base, 1 << 16), _table(pow(base, 1 << 16, 1 << 64), 1 << 16)

    def __call__(self, i: np.ndarray) -> np.ndarray:
        return self.low[i & 0xFFFF] * self.high[i >> 16]


_UP, _DOWN = _Powers(_P), _Powers(pow(_P, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text ended by END, and the number of tokens of each."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", dtype=np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP(np.arange(len(b))), out=sums[1:])
    h = _mix((sums[end] - sums[start]) * _DOWN(start) + (end - start).astype(np.uint64))
    last = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, last)  # words before the end of each text
    n = np.diff(np.concatenate(([0], upto))) + 1
    out = np.empty(int(n.sum()), dtype=np.uint64)
    ends = np.cumsum(n) - 1
    words = np.ones(len(out), dtype=bool)
    words[ends] = False
    out[words], out[ends] = h, END
    return out, n


def pack(a: np.ndarray) -> bytes:
    """Small whole numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def _bucket(h: np.ndarray, k: int) -> np.ndarray:
    """The upper k bits of hashes: a bucket's hashes are neighbours in ascending order."""
    return (h >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(h), dtype=np.int64)


def _short(h: np.ndarray, k: int) -> bytes:
    """48 bits of each hash, those after the upper k that tell the bucket."""
    return np.ascontiguousarray(((h << np.uint64(k)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_short(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(raw, ((0, 0), (0, 2)))).view("<u8").reshape(-1)


class Block(NamedTuple):
    """Documents of a relay: their ids and folds, numbers of tokens, the block's different words (hashes) and its tokens (packed places of words)."""

    ids: list[str | None]
    fold: list[int]
    n: list[int]
    words: bytes
    tokens: bytes


_RELAY = "relay string, tune boolean, ids array<array<string>>, fold array<array<int>>, n array<array<int>>, words array<binary>, tokens array<binary>, n_words long, n_tokens long"


def blocks_of(row) -> Iterator[Block]:
    """The blocks of a row of relays."""
    return itertools.starmap(Block, zip(row.ids, row.fold, row.n, row.words, row.tokens, strict=True))


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def _relays(frames: Iterator[pd.DataFrame], block_tokens: int, relay_blocks: int) -> Iterator[pd.DataFrame]:
    """Relays of blocks of documents; those that tune the weights stand in relays of their own."""
    from pyspark import TaskContext

    task, numbers = TaskContext.get().partitionId(), itertools.count()
    held: dict[bool, list] = {True: [], False: []}
    made: dict[bool, list[Block]] = {True: [], False: []}

    def close(tune: bool) -> None:
        parts, held[tune] = held[tune], []
        h = np.concatenate([p[0] for p in parts])
        words, index, count = np.unique(h, return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")  # common words get small numbers, which pack well
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        ids = [i for p in parts for i in p[2]]
        made[tune].append(Block(ids, np.concatenate([p[3] for p in parts]).tolist(), np.concatenate([p[1] for p in parts]).tolist(), words[by].tobytes(), pack(place[index])))

    def relay(tune: bool) -> pd.DataFrame:
        blocks, made[tune] = made[tune], []
        row = (f"{task}-{next(numbers)}", tune, *map(list, zip(*blocks, strict=True)), sum(len(b.words) // 8 for b in blocks), sum(sum(b.n) for b in blocks))
        return pd.DataFrame([row], columns=_names(_RELAY))

    for frame in frames:
        for tune in (True, False):
            f = frame[(frame["fold"] == TUNE) == tune]
            if len(f):
                h, n = word_hashes(f["text"].tolist())
                held[tune].append((h, n, f["id"].tolist(), f["fold"].to_numpy()))
                if sum(len(p[0]) for p in held[tune]) >= block_tokens:
                    close(tune)
                    if len(made[tune]) == relay_blocks:
                        yield relay(tune)
    for tune in (True, False):
        if held[tune]:
            close(tune)
        if made[tune]:
            yield relay(tune)


def _pairs(words: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: the place of the token before it (END before the first), and a hash of the two."""
    end = int(np.flatnonzero(words == np.uint64(END))[0])
    before = np.concatenate(([end], tokens[:-1]))
    before[np.cumsum(n)[:-1]] = end
    return before, _mix(words[before] * np.uint64(_P) + words[tokens])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], slices: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different hashes of parts (ascending hashes, counts) and the sums of their counts, a slice of the hashes after another."""
    if len(parts) == 1:
        return parts[0]
    found = []
    cuts = [np.searchsorted(h, np.array([(s << 64) // slices for s in range(1, slices)], dtype=np.uint64)).tolist() for h, _ in parts]
    for s in range(slices):
        own = [slice(c[s - 1] if s else 0, c[s] if s + 1 < slices else None) for c in cuts]
        hashes, at = np.unique(np.concatenate([h[o] for (h, _), o in zip(parts, own, strict=True)]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([n[o] for (_, n), o in zip(parts, own, strict=True)]), minlength=len(hashes))
        found.append((hashes, sums.astype(np.int32)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _seen(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the words and of the pairs of a block: ascending hashes, and how often each stands in training texts."""
    words, tokens, n = np.frombuffer(block.words, dtype=np.uint64), unpack(block.tokens), np.array(block.n)
    learn = np.repeat(np.array(block.fold) != HELD_OUT, n)
    _, pair = _pairs(words, tokens, n)
    upair, at = np.unique(pair, return_inverse=True)
    order = np.argsort(words)
    return [(words[order], np.bincount(tokens[learn], minlength=len(words)).astype(np.int32)[order]), (upair, np.bincount(at[learn], minlength=len(upair)).astype(np.int32))]


def _ask(frames: Iterator[pd.DataFrame], k: int, messages: int = 256) -> Iterator[pd.DataFrame]:
    """The questions of each relay: the words and pairs of a bucket in ascending order, with the relay's own counts."""
    for frame in frames:
        for row in frame.itertuples():
            seen = list(map(_seen, blocks_of(row)))
            for kind in (0, 1):
                h, n = _merged([block[kind] for block in seen])
                for block in seen:
                    block[kind] = None
                bucket = _bucket(h, k)
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=True))
                for i in range(0, len(spans), messages):
                    yield pd.DataFrame([(kind, int(bucket[a]), row.relay, row.tune, h[a:b].tobytes() if kind == 0 else _short(h[a:b], k), pack(n[a:b])) for a, b in spans[i : i + messages]], columns=_names(_QUESTION))


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of a bucket's words or pairs to every relay that asked, and the bucket's totals (relay null).

    full counts all training texts, part those that tune, which only their
    relays need.
    """
    kind, bucket = int(frame["kind"].iloc[0]), int(frame["bucket"].iloc[0])
    asked = [np.frombuffer(b, dtype=np.uint64) if kind == 0 else _from_short(b) for b in frame["hashes"]]
    ends = np.cumsum([len(a) for a in asked])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([unpack(b) for b in frame["n"]])
    full = np.bincount(at, weights=counts).astype(np.int64)
    counts *= np.repeat(frame["tune"].to_numpy(), np.diff(ends, prepend=0))
    part = np.bincount(at, weights=counts).astype(np.int64)
    rows = [(kind, bucket, relay, pack(full[at[a:b]]), pack(part[at[a:b]]) if tune else None, 0, 0, 0, 0) for relay, tune, a, b in zip(frame["relay"], frame["tune"], [0, *ends[:-1]], ends, strict=True)]
    if kind == 0:
        rest = full - part
        rows.append((kind, bucket, None, None, None, int(full.sum()), int((full > 0).sum()), int(rest.sum()), int((rest > 0).sum())))
    return pd.DataFrame(rows, columns=_names(_ANSWER))


_QUESTION = "kind int, bucket int, relay string, tune boolean, hashes binary, n binary"
_ANSWER = "kind int, bucket int, relay string, full binary, part binary, n_full long, v_full long, n_rest long, v_rest long"


class _Scored:
    """A block with the corpus counts of its tokens: word, context (the token before) and pair."""

    def __init__(self, block: Block, known: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.block, self.n = block, np.array(block.n)
        words, tokens = np.frombuffer(block.words, dtype=np.uint64), unpack(block.tokens)
        before, pair = _pairs(words, tokens, self.n)
        upair, at = np.unique(pair, return_inverse=True)
        self.word, self.context, self.pair = {}, {}, {}
        for what, ((own_words, word_counts), (own_pairs, pair_counts)) in known.items():
            got = word_counts[np.searchsorted(own_words, words)]
            self.word[what], self.context[what] = got[tokens], got[before]
            self.pair[what] = pair_counts[np.searchsorted(own_pairs, upair)][at]


def _scored(row, answers: pd.DataFrame) -> Iterator[_Scored]:
    """The blocks of a relay, one by one, with the answers to it."""
    blocks = list(blocks_of(row))
    words = np.unique(np.concatenate([np.frombuffer(b.words, dtype=np.uint64) for b in blocks]))
    pairs, _ = _merged([_seen(b)[1] for b in blocks])
    known: dict[str, list] = {what: [] for what in (("full", "part") if row.tune else ("full",))}
    for kind, hashes in enumerate((words, pairs)):
        own = answers[answers["kind"] == kind].sort_values("bucket")
        for what, counts in known.items():
            counts.append((hashes, np.concatenate([unpack(b) for b in own[what]])))
    for block in blocks:
        yield _Scored(block, known)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts that were not seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _ratios(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram likelihood over the uniform one."""
    v = vocabulary + 1
    return v * pair / np.maximum(context, 1), v * word / max(total, 1)


def learn_weights(cells: pd.DataFrame, rounds: int = 200) -> np.ndarray:
    """weights[bucket] of (bigram, unigram, uniform), by expectation-maximisation on (bucket, r2, r1, n), n tokens of likelihood ratios r2 and r1.

    A bucket without held-out tokens takes the weights of the next lower one.
    """
    weights = np.tile([0.0, 0.9, 0.1], (66, 1))
    known = [0.0, 0.9, 0.1]
    for bucket in range(66):
        c = cells[cells["bucket"] == bucket]
        if len(c):
            r = np.stack([c["r2"], c["r1"], np.ones(len(c))])
            n = c["n"].to_numpy(dtype=float)
            w = np.array([1 / 3, 1 / 3, 1 / 3])
            for _ in range(rounds):
                share = w[:, None] * r
                w = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
            w = np.maximum(w, [0, 1e-6, 1e-6])
            known = w / w.sum()
        weights[bucket] = known
        if bucket == 0:
            weights[0] = [0, known[1] / (known[1] + known[2]), known[2] / (known[1] + known[2])]
    return weights


def _histogram(s: _Scored, total: int, vocabulary: int) -> pd.DataFrame:
    word, context, pair = (x["full"] - x["part"] for x in (s.word, s.context, s.pair))
    r2, r1 = _ratios(word, context, pair, total, vocabulary)
    step = lambda r: np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-30)) * STEPS), -10_000).astype(np.int64)
    cells = pd.DataFrame({"bucket": bucket_of(context), "s2": step(r2), "s1": step(r1)})
    return cells.value_counts().reset_index(name="n")[["bucket", "s2", "s1", "n"]]


def _scores(s: _Scored, weights: np.ndarray, total: int, vocabulary: int) -> pd.DataFrame:
    word, context, pair = s.word["full"], s.context["full"], s.pair["full"]
    r2, r1 = _ratios(word, context, pair, total, vocabulary)
    w = weights[bucket_of(context)]
    model = np.log10(w[:, 0] * r2 + w[:, 1] * r1 + w[:, 2]) - math.log10(vocabulary + 1)
    base = np.log10(word + 1) - math.log10(total + vocabulary + 1)
    at = np.cumsum(s.n) - s.n
    known = np.add.reduceat((word > 0).astype(np.int64), at)
    return pd.DataFrame({"id": list(s.block.ids), "held_out": np.array(s.block.fold) == HELD_OUT, "n_tokens": s.n.astype(np.int64), "n_known": known, "train_tokens": total, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(model, at)})


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, relay_blocks: int = RELAY_BLOCKS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: id (of the type it has), held_out, n_tokens, n_known, train_tokens, base_score, score (sums of log10 over tokens).

    Tokens are words (A-Z lower-cased) and one end per text. Documents whose
    crc32(id as text) modulo FOLDS is HELD_OUT are not learned from. base_score
    is the add-one unigram, score the interpolated model. Null texts are empty
    and have the end alone; a null id counts as remainder 0; repeated rows stay
    rows; an empty table gives none; other columns are not read.
    """
    small_batches(spark_of(docs), 400)
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), fold.alias("fold"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    relays = materialize(rows.mapInPandas(lambda it: _relays(it, block_tokens, relay_blocks), _RELAY), "lm-relays")
    size = relays.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    k = max(0, math.ceil(math.log2(max(1, ((size["w"] or 0) + (size["t"] or 0)) / bucket_entries))))
    asked = relays.mapInPandas(lambda it: _ask(it, k), _QUESTION)
    answers = materialize(asked.groupBy("kind", "bucket").applyInPandas(_answer, _ANSWER), "lm-answers")
    sums = answers.where("relay is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_full", "v_full", "n_rest", "v_rest")]).first()
    answers = answers.where("relay is not null").select("relay", "kind", "bucket", "full", "part")

    def each(which: str, given: str, step, schema: str) -> DataFrame:
        def scored(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([step(block) for row in own.itertuples() for block in _scored(row, got)])

        return relays.where(which).groupBy("relay").cogroup(answers.where(given).groupBy("relay")).applyInPandas(scored, schema)

    n_rest, v_rest, n_full, v_full = sums["n_rest"], sums["v_rest"], sums["n_full"], sums["v_full"]
    cells = each("tune", "part is not null", lambda s: _histogram(s, n_rest, v_rest), "bucket long, s2 long, s1 long, n long")
    # bounded: at most 66 buckets times the steps of two ratios, whatever the corpus
    cells = cells.groupBy("bucket", "s2", "s1").agg(F.sum("n").alias("n")).toPandas()
    for r, s in (("r2", "s2"), ("r1", "s1")):
        cells[r] = np.where(cells[s] == -10_000, 0.0, 2.0 ** (cells[s].clip(-1000, 1000) / STEPS))
    weights = learn_weights(cells)
    scores = each("true", "true", lambda s: _scores(s, weights, n_full, v_full), "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
