"""Token counts by byte-pair merging on a heap and a linked list.

For each pre-token the adjacent pair of lowest rank (leftmost on ties) is popped
and merged until no ranked pair is left. The count is the number of initial
symbols less the number of merges; no token ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, spark_of

# Unicode White_Space, and the pre-token pattern of the byte-level vocabularies.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WS}\\p{{L}}\\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_OTHER_WS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

#: Entries a worker keeps of chunk counts before it starts anew; bounds memory, not results.
CACHE_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def uneven(text: str) -> bool:
    """Whether a space may stand at an end or beside other white space; true too for texts with rare white space."""
    return text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_WS)


class Merger:
    """Counts tokens of texts with the merge ranks of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pretoken = regex.compile(_PRETOKEN)
        self.seen: dict[str, int] = {}
        self.lead = _Chunks(self, "")
        self.follow = _Chunks(self, " ")

    def merged(self, token: str) -> int:
        """Number of tokens of one pre-token."""
        part = [self.symbol[b] for b in token.encode("utf-8", "surrogatepass")]
        n = len(part)
        if n < 2:
            return n
        rank = self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # a neighbour has changed since this pair was pushed
            part[i], part[j] = a + b, ""
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, part[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, part[k]))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, part[h], a + b))
        return n - merges

    def pretokens(self, text: str) -> int:
        seen, total = self.seen, 0
        for token in self.pretoken.findall(text):
            n = seen.get(token)
            if n is None:
                n = self.merged(token)
                if len(token) <= 64:
                    if len(seen) >= CACHE_ENTRIES:
                        seen.clear()
                    seen[token] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Count of a text without special strings.

        A single space between two other characters always starts a new
        pre-token, so such texts are counted chunk by chunk from a cache.
        """
        if uneven(text):
            return self.pretokens(text)
        first, *rest = text.split(" ")
        return self.lead[first] + sum(map(self.follow.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, total = [text], 0
        for s in self.special:
            parts = [y for x in parts for y in x.split(s)]
        total = len(parts) - 1
        return total + sum(self.plain(p) for p in parts if p)


class _Chunks(dict):
    """Counts by chunk, filled when asked."""

    def __init__(self, merger: Merger, before: str):
        super().__init__()
        self.merger, self.before = merger, before

    def __missing__(self, chunk: str) -> int:
        n = self.merger.pretokens(self.before + chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids
    stay as rows; other columns are not read. An empty table gives no rows.
    vocabulary: path of a byte-level BPE file that every executor can open.
    """
    small_batches(spark_of(docs))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = Merger(vocabulary)
        for s in texts:
            yield s.map(merger.count).astype("int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
