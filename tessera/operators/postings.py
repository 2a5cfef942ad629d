"""An inverted index of texts: what searches read instead of the texts.

The index is a folder of tables, each partitioned by generation and by bucket of
the word:

    postings   word, field, id, n, first_line: how often a field of a document has a word, and where first
    words      word: the different words, for searches by a part of a word
    ids        id: the documents of a generation

A generation is written once and never changed; adding rows writes one more, and
a document of a later generation takes the place of its earlier state. Writing a
generation again replaces it. A search reads the buckets of its words and, in
them, the row groups that may have these words.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.memory import SEARCH_TOP, words

BUCKETS = 16


@dataclass(frozen=True)
class Index:
    """Where an index is, and the names of its documents' id and fields."""

    folder: str
    id: str = "id"
    fields: tuple[str, ...] = ("text",)
    buckets: int = BUCKETS


def bucket(word: Column, buckets: int) -> Column:
    return F.crc32(word.cast("binary")) % buckets


def _buckets(terms: Iterable[str], buckets: int) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % buckets for t in terms})


def postings_of(docs: DataFrame, index: Index) -> DataFrame:
    """word, field, id, n, first_line of docs; lines count from 1. A word of a document meets itself in its own row, so nothing but whole rows leave it."""

    def of(field: str) -> Column:
        lines = F.filter(F.transform(F.split(F.lower(field), "\n", -1), lambda s, k: F.transform(words(s), lambda w: F.struct(w.alias("word"), (k + 1).cast("int").alias("line")))), lambda ws: F.size(ws) > 0)
        return F.transform(F.flatten(lines), lambda w: F.struct(w["word"].alias("word"), F.lit(field).alias("field"), w["line"].alias("line")))

    each = docs.select(F.col(index.id).alias("id"), F.inline(F.concat(*[F.coalesce(of(f), F.array().cast("array<struct<word:string,field:string,line:int>>")) for f in index.fields])))
    return each.groupBy("word", "field", "id").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def add(docs: DataFrame, index: Index, generation: int = 0) -> None:
    """Write docs as a generation of the index; generations count up, and a document of a later one replaces its earlier state."""
    whole = docs.where(F.col(index.id).isNotNull())
    placed = postings_of(whole, index).withColumn("bucket", bucket(F.col("word"), index.buckets))
    # one bucket in one task would not scale: a bucket is split by word ranges, so that a word's rows still lie together
    placed = placed.repartitionByRange("bucket", "word", "id").sortWithinPartitions("bucket", "word", "id")
    at = f"gen={int(generation)}"
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.folder}/postings/{at}")
    spark = docs.sparkSession
    held = spark.read.parquet(f"{index.folder}/postings/{at}")
    held.select("bucket", "word").distinct().write.mode("overwrite").partitionBy("bucket").parquet(f"{index.folder}/words/{at}")
    whole.select(F.col(index.id).alias("id")).distinct().write.mode("overwrite").parquet(f"{index.folder}/ids/{at}")


def _table(spark: SparkSession, index: Index, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{index.folder}/{name}").parquet(f"{index.folder}/{name}/gen=*")


def postings(spark: SparkSession, index: Index, terms: list[str] | None = None) -> DataFrame:
    """The postings that hold, of some words or of all: those of a document's last generation."""
    rows = _table(spark, index, "postings")
    if terms is not None:
        rows = rows.where(F.col("bucket").isin(_buckets(terms, index.buckets)) & F.col("word").isin(terms))
    return _current(spark, index, rows)


def _current(spark: SparkSession, index: Index, rows: DataFrame) -> DataFrame:
    ids = _table(spark, index, "ids")
    replaced = ids.groupBy("id").agg(F.max("gen").alias("last"), F.min("gen").alias("first")).where("first < last").select("id", "last")
    return rows.join(replaced, "id", "left").where("last is null or gen = last").drop("last", "gen", "bucket")


def is_letter(c: str) -> bool:
    """What words are made of: letters and decimal digits."""
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd"


def query_runs(query: str) -> list[tuple[str, bool, bool]]:
    """(run, open to the left, open to the right) of the words of a lower-cased query; a run at an end of it may go on there in a text."""
    runs, at, n = [], 0, len(query)
    while at < n:
        end = at
        while end < n and is_letter(query[end]):
            end += 1
        if end > at:
            runs.append((query[at:end], at == 0, end == n))
        at = max(end, at + 1)
    return runs


def having(spark: SparkSession, index: Index, query: str) -> DataFrame | None:
    """id: documents with a field that may hold query, blind to case: it has a word for each of its runs. None if the query has no words, so that any may.

    Runs open to a side are looked up in the table of words; the postings of
    those found are read, and no text.
    """
    runs = query_runs(query.lower())
    if not runs:
        return None
    found = None
    for k, (run, left, right) in enumerate(runs):
        if not left and not right:
            rows = postings(spark, index, [run])
        else:
            test = {(True, True): F.contains, (True, False): F.endswith, (False, True): F.startswith}[left, right]
            named = _table(spark, index, "words").where(test(F.col("word"), F.lit(run))).select("bucket", "word").distinct()
            rows = _current(spark, index, _table(spark, index, "postings").join(named, ["bucket", "word"], "left_semi"))
        own = rows.select("id", "field", F.lit(k).alias("run"))
        found = own if found is None else found.unionByName(own)
    held = found.distinct().groupBy("id", "field").agg(F.count("*").alias("runs"))
    return held.where(F.col("runs") == len(runs)).select("id").distinct()


def _candidates(docs: DataFrame, index: Index, query: str) -> DataFrame:
    ids = having(docs.sparkSession, index, query)
    return docs if ids is None else docs.join(ids.withColumnRenamed("id", index.id), index.id, "left_semi")


def keyword_search(docs: DataFrame, index: Index, query: str, name: str, text: str) -> DataFrame:
    """search.keyword_search() by the index, best score first, ties by id; only documents that may have a hit are read whole."""
    return search.keyword_search(_candidates(docs, index, query), query, name, text).orderBy(F.desc("score"), index.id)


def like_top(docs: DataFrame, index: Index, query: str, name: str, text: str, limit: int = 20) -> DataFrame:
    """search.like_top() by the index."""
    return search.like_top(_candidates(docs, index, query), query, name, text, limit)


def full_text(spark: SparkSession, index: Index, query: str, field: str = "text", limit: int = SEARCH_TOP) -> DataFrame:
    """id, rank: the `limit` documents of highest rank with every word of the query, ties by id: memory.full_text() from postings alone."""
    terms = sorted({run for run, _, _ in query_runs(query.lower())})
    rows = postings(spark, index, terms).where(F.col("field") == field)
    per = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("found")).where(F.size("found") == len(terms))
    total = F.aggregate("found", F.lit(0.0), lambda a, w: a + w["n"] / (w["n"] + 1))
    return per.select("id", (total / max(1, len(terms))).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)


def first_lines(spark: SparkSession, index: Index, query: str, field: str = "text") -> DataFrame:
    """word, id, n, first_line of each word of the query."""
    terms = sorted({run for run, _, _ in query_runs(query.lower())})
    return postings(spark, index, terms).where(F.col("field") == field).select("word", "id", "n", "first_line")

