"""Spelling variants by a dictionary of trie-node pairs.

Words are sorted, and the nodes of their trie are numbered along the way: a word
shares its first nodes with the word before. So are reversed words. A word
parted at a place is a pair of integers then, the node of what stands before and
that of what stands behind. Skipping a letter gives another pair. Two words that
skip to equal pairs differ in one replaced letter; a word that is parted where
another skips lacks one letter of it. These are all the words at a distance of
one, exactly.

Only nodes that two words share are numbered, since pairs of others meet none:
most words keep few places. Tries are built in ranges of the sorted words; nodes
that reach over the end of a range are those of the words at its ends, which
every task knows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize, ship, spark_of

#: What words are made of: letters of Latin-1 (and its two signs among them).
LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A near word is the form of another if it is so many times as frequent.
MIN_RATIO = 10
#: Words of a range, which is one task's: their tries are built row by row.
RANGE_WORDS = 20_000

#: Words parted at a place; words that skip a letter; those of them that skip the last of equal letters.
_PARTED, _SKIPPED, _LAST = 0, 1, 2


def typo(run: Column, doc_id: Column, every: int) -> Column:
    """run without one letter if `every` divides the CRC-32 of `doc_id:run`; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of LETTERS of whole texts, A-Z lower-cased, with `min_length` letters and `min_count` occurrences or more.

    typo_every plants typos first, see typo(). Null texts have no words.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{min_length},}}+"), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    # lower() knows more letters than A-Z, so it is for runs of ASCII alone
    plain = F.octet_length("run") == F.char_length("run")
    run = F.when(plain, F.lower("run")).otherwise(ascii_lower(F.col("run")))
    found = found.select("id", run.alias("run"))
    word = typo(F.col("run"), F.col("id"), typo_every) if typo_every else F.col("run")
    found = found.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def border_paths(firsts: list[str]) -> list[list[int]]:
    """Numbers of the nodes along the first words of sorted ranges, from the root (0) on."""
    paths, fresh, before = [], 1, ""
    for word in firsts:
        shared = common_prefix(before, word)
        path = paths[-1][: shared + 1] if paths else [0]
        path += range(fresh, fresh + len(word) - len(path) + 1)
        fresh += len(word) - shared
        paths.append(path)
        before = word
    return paths


def numbered(rows: Iterator[tuple], ranges: list[tuple[int, str, str]]) -> Iterator[tuple[tuple, list[int]]]:
    """rows (range, word, ...) in order, each with the numbers of its nodes from the root to the last that it shares with another word.

    ranges: (range, first word, last word) of all of them, in order.
    """
    order = {r: q for q, (r, _, _) in enumerate(ranges)}
    paths = border_paths([first for _, first, _ in ranges])
    row = next(rows, None)
    current, before, path, fresh = None, "", [0], 0
    while row:
        following = next(rows, None)
        q, word = order[row[0]], row[1]
        end = ranges[q + 1][1] if q + 1 < len(ranges) else None
        after = following[1] if following and following[0] == row[0] else end
        if row[0] != current:
            current, fresh = row[0], (q + 1) << 40
            before = ranges[q - 1][2] if q else ""
            own = common_prefix(before, word)
            path = paths[q]
        else:
            own = common_prefix(before, word)
            path = path[: own + 1]
        shared = max(own, common_prefix(word, after) if after is not None else 0)
        path = path[: shared + 1]
        if len(path) <= shared:
            known = common_prefix(word, end) if end is not None else 0
            while len(path) <= shared:
                if len(path) <= known:
                    path.append(paths[q + 1][len(path)])
                else:
                    fresh += 1
                    path.append(fresh)
        yield row, path
        before, row = word, following


def places(word: str, forward: list[int], backward: list[int]) -> Iterator[tuple[int, int, int]]:
    """(node before, node behind, kind) of the places of a word whose two nodes are shared ones."""
    n, a, b = len(word), len(forward) - 1, len(backward) - 1
    for i in range(max(0, n - b), min(a, n) + 1):
        yield forward[i], backward[n - i], _PARTED
    for i in range(max(0, n - 1 - b), min(a, n - 1) + 1):
        yield forward[i], backward[n - 1 - i], _LAST if i + 1 == n or word[i] != word[i + 1] else _SKIPPED


def _rows(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(frame[c].tolist() for c in columns), strict=True)


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def sorted_ranges(rows: DataFrame, col: str, name: str, ranges: int | None = None) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """rows in `ranges` ranges of col (as many as a shuffle has partitions by default), a range a partition, each sorted, with `range` and `at` (in order over all of them); and the ranges' first and last words, one of each per partition."""
    held = (rows.repartitionByRange(ranges, col) if ranges else rows.repartitionByRange(col)).sortWithinPartitions(col)
    held = materialize(held.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    ends = held.groupBy("range").agg(F.min(col).alias("first"), F.max(col).alias("last")).collect()
    edges = sorted((r["range"], r["first"], r["last"]) for r in ends)
    most = max([r[0] for r in edges], default=0) + 1
    return held.repartitionById(most, "range").sortWithinPartitions("at"), edges


def near_pairs(words: DataFrame, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) with ids in order of the words, and p, s, id, n, kind: the places of every word as pairs of nodes.

    words: word, n; words are distinct and not null.
    """
    ship(spark_of(words))
    size = max(1, math.ceil(words.count() / range_words))
    held, ranges = sorted_ranges(words.select("word", "n"), "word", "spelling-words", size)

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = numbered(_rows(frames, ["range", "word", "n", "at"]), ranges)
        yield from _frames(((at, word[::-1], n, list(path)) for (_, word, n, at), path in found), ["id", "reversed", "n", "forward"])

    ahead = held.mapInPandas(forward, "id long, reversed string, n long, forward array<long>")
    back, back_ranges = sorted_ranges(ahead, "reversed", "spelling-reversed", size)

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = numbered(_rows(frames, ["range", "reversed", "id", "n", "forward"]), back_ranges)
        rows = ((p, s, at, n, kind) for (_, word, at, n, front), path in found for p, s, kind in places(word[::-1], front, path))
        yield from _frames(rows, ["p", "s", "id", "n", "kind"])

    pairs = back.mapInPandas(backward, "p long, s long, id long, n long, kind int")
    return held.select(F.col("at").alias("id"), "word", "n"), pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """id, n_near, best: how many words are near each word that has any, and (n, -id) of the most frequent, of several the first.

    A pair of nodes has one word that is parted there, and of words that skip
    there one per letter: a group is bounded by the alphabet.
    """
    cell = F.struct("kind", "id", "n", F.struct("n", (-F.col("id")).alias("m")).alias("rank"))
    groups = pairs.groupBy("p", "s").agg(F.collect_list(cell).alias("g")).where(F.size("g") > 1)
    ranks = lambda x: F.transform(x, lambda w: w["rank"])
    groups = groups.select("g", ranks(F.filter("g", lambda w: w["kind"] > _PARTED)).alias("skipped"), ranks(F.filter("g", lambda w: w["kind"] == _LAST)).alias("last"), ranks(F.filter("g", lambda w: w["kind"] == _PARTED)).alias("parted"))
    groups = groups.withColumn("top", F.slice(F.reverse(F.array_sort("skipped")), 1, 2))

    def told(w: Column) -> Column:
        other = F.when(F.get("top", F.lit(0)) == w["rank"], F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0)))
        short = F.when(w["kind"] == _LAST, F.get("parted", F.lit(0)))
        n = F.when(w["kind"] == _PARTED, F.size("last")).otherwise(F.size("skipped") - 1 + short.isNotNull().cast("int"))
        best = F.when(w["kind"] == _PARTED, F.array_max("last")).otherwise(F.array_max(F.array(other, short)))
        return F.struct(w["id"].alias("id"), n.cast("long").alias("near"), best.alias("best"))

    each = groups.select(F.inline(F.transform("g", told))).where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """id, root: where the forms of links (id, form) lead in the end.

    Every form is more frequent than its word, so there are no rings, and a way
    is no longer than the logarithm of the largest count; each round doubles
    what it has covered.
    """
    roots = materialize(links.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        roots = materialize(roots.join(further.hint("merge"), "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").limit(1).count() == 0:
            return roots.select("id", "root")
        roots = roots.select("id", "root")


def spelling_variants(words: DataFrame, min_ratio: int = MIN_RATIO, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n).

    n_near: words that differ by one inserted, deleted or replaced code point.
    form: the most frequent of them (of several the first in code-point order)
    if it occurs min_ratio times as often, else null; form_n: its n. root:
    where forms lead in the end, the word itself if it has none. Rows of equal
    words add their counts; null words and null counts are left out; an empty
    table gives no rows; other columns are not read.
    """
    given = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known, pairs = near_pairs(materialize(given, "spelling-counts"), range_words)
    near = neighbours(pairs)
    rows = known.join(near.hint("merge"), "id", "left")
    rows = rows.withColumn("form", F.when(F.col("best.n") >= min_ratio * F.col("n"), -F.col("best.m")))
    rows = materialize(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form"), "spelling-near")
    links = rows.where("form is not null").select("id", "form")
    roots = last_forms(links)
    names = rows.select("id", "word", "n")
    form = names.select(F.col("id").alias("form_id"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = names.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    chains = links.join(roots, "id").join(form.hint("merge"), F.col("form") == F.col("form_id")).join(root.hint("merge"), F.col("root") == F.col("root_id"))
    chains = chains.select("id", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root"))
    out = rows.drop("form").join(chains.hint("merge"), "id", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
