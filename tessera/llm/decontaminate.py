"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of item words. The tokens of a window are put in
order of rarity in the documents; a containment of 1 needs a prefix of one
token, so a window can only occur where its rarest word does. Documents meet
items on those words alone, with the positions of both: the alignment has to
leave room for the window in the document, and then the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, hot_keys, materialize, salted_join, split_words

#: What parts words, after A-Z have been lower-cased.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
#: Prefix entries, and bytes of their words and items, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ENTRIES = 200_000
BROADCAST_BYTES = 32_000_000


def words(text_col: str) -> Column:
    return split_words(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD)


def item_windows(items: DataFrame, rarity: DataFrame, size: int = WINDOW) -> DataFrame:
    """anchor, item_words, anchor_at, starts, length, ids: per item and position of a rarest word, the windows it stands for.

    Only the words of these windows are kept, fewer than two windows' lengths;
    anchor_at and starts count from the first of them.

    items: item_words (distinct), ids. rarity: word, n. Ties go to the word that
    comes first by code point, then to its first place in the item.
    """
    n = F.size("item_words")
    at = items.where(n > 0).select("item_words", F.posexplode("item_words").alias("at", "word"))
    ranked = at.join(rarity, "word", "left").select("item_words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("token"))
    ordered = ranked.groupBy("item_words").agg(F.sort_array(F.collect_list("token")).alias("by_rarity"))
    ordered = ordered.select("item_words", F.transform("by_rarity", lambda t: t["at"]).alias("by_rarity"), F.least(F.lit(size), n).alias("length"))
    windows = ordered.select("*", F.explode(F.sequence(F.lit(0), n - F.col("length"))).alias("start"))
    prefix = F.filter("by_rarity", lambda i: (i >= F.col("start")) & (i < F.col("start") + F.col("length")))[0]
    windows = windows.select("item_words", "length", "start", prefix.alias("anchor_at"))
    windows = windows.groupBy("item_words", "length", "anchor_at").agg(F.sort_array(F.collect_list("start")).alias("starts")).join(items, "item_words")
    first = F.col("starts")[0]
    return windows.select(
        F.col("item_words")[F.col("anchor_at")].alias("anchor"),
        F.slice("item_words", first + 1, F.array_max("starts") + F.col("length") - first).alias("item_words"),
        (F.col("anchor_at") - first).alias("anchor_at"),
        F.transform("starts", lambda s: s - first).alias("starts"),
        "length",
        "ids",
    )


def _verified(cand: DataFrame) -> DataFrame:
    """Windows of the aligned items that stand in the documents word for word: __k1, __k2, start, length, ids.

    Explode and slice stay in one generated stage with the join before them, so
    a document's words are never copied for the positions that meet no item.
    """
    start = F.col("shift") + F.col("i")
    fits = (start >= 0) & (start + F.col("length") <= F.size("doc_words"))
    equal = F.slice("doc_words", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.slice("item_words", F.col("i") + 1, F.col("length"))
    return cand.withColumn("i", F.explode("starts")).where(fits & equal).select("__k1", "__k2", start.alias("start"), "length", "ids")


def occurrences(split: DataFrame, items: DataFrame, size: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """__k1, __k2, start, length, ids: every occurrence of a window of an item in a document of split (__k1, __k2, doc_words)."""
    texts = items.select(F.col(item_col).cast("string").alias("item_id"), words(item_text_col).alias("item_words"))
    distinct = texts.groupBy("item_words").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    vocabulary = distinct.select(F.explode("item_words").alias("word")).distinct()
    if vocabulary.count() <= BROADCAST_ENTRIES:
        vocabulary = F.broadcast(vocabulary)
    # explode_outer: explode would first filter on the size of the words, and make them a second time for that
    rarity = split.select(F.explode_outer("doc_words").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    rarity = materialize(rarity, "decontaminate-rarity")
    windows = materialize(item_windows(distinct, rarity, size), "decontaminate-windows")
    held = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("item_words", " ")) + F.octet_length(F.array_join("ids", " "))).alias("bytes")).first()
    tokens = split.select("__k1", "__k2", "doc_words", F.posexplode_outer("doc_words").alias("pos", "anchor"))
    aligned = (F.col("pos") - F.col("anchor_at")).alias("shift")
    if held["n"] <= BROADCAST_ENTRIES and (held["bytes"] or 0) <= BROADCAST_BYTES:
        return _verified(tokens.join(F.broadcast(windows), "anchor").select("__k1", "__k2", "doc_words", "item_words", "length", "starts", "ids", aligned))
    # a large benchmark: meet on the words alone, then fetch the documents of the alignments
    common = hot_keys(rarity.select(F.col("word").alias("anchor"), "n"), ["anchor"], "n")
    met = salted_join(tokens.drop("doc_words"), windows, ["anchor"], common, F.xxhash64("__k1", "pos"))
    met = met.select("__k1", "__k2", "item_words", "length", "starts", "ids", aligned).distinct()
    return _verified(met.join(split.dropDuplicates(["__k1", "__k2"]), ["__k1", "__k2"]))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    A window is `size` consecutive item words; a shorter item is one window,
    one without words none. A document word inside any occurrence of a window
    is hit; contaminated: some word is hit, and hit words are a twentieth of
    all or more. Null texts have no words. Items with equal words occur
    together and each counts, but null item ids do not. Repeated rows and null
    ids are documents of their own. Empty tables give no hits. Clashing column
    names of docs are replaced by the results; names that begin with two
    underscores are reserved.
    """
    made = {"n_words", "n_hit", "n_items", "item_ids", "contaminated"}
    base = docs.drop(*(made & set(docs.columns)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # equal texts have equal results, so hits come back by the text's two digests
    base = base.select("*", F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"), words(text_col).alias("__words"))
    hits = occurrences(base.select("__k1", "__k2", F.col("__words").alias("doc_words")), items, size, item_col, item_text_col)
    per = hits.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    per = per.select("__k1", "__k2", F.size(covered).cast("long").alias("n_hit"), "item_ids")
    per = materialize(per, "decontaminate-hits")  # so that the join below can split a text with very many copies
    out = base.withColumn("n_words", F.size("__words").cast("long")).drop("__words").join(per, ["__k1", "__k2"], "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    out = out.withColumn("n_items", F.size("item_ids").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("__k1", "__k2")
