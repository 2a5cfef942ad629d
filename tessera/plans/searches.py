"""Searches by an inverted index of the documents, beside SQL over the texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import postings
from tessera.plans import table
from tessera.plans.memories import _FULL
from tessera.shipping import shared_dir


def indexed(spark, sf_dir):
    """The documents, and an index of them in two generations: some documents are of both, with a stale text in the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = postings.Index(f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id", ("source", "text"))
    stale = docs.where("doc_id % 5 = 0").withColumn("text", F.lit("the was Sthed bo stale"))
    postings.add(docs.where("doc_id % 5 != 0").unionByName(stale), index, 0)
    postings.add(docs.where("doc_id % 5 = 0"), index, 1)
    return docs, index


def index_search(spark, sf_dir):
    """Full text for two words, a keyword inside words, a part of two words, and a name: by the index."""
    docs, index = indexed(spark, sf_dir)
    told = lambda df, kind, score: df.select(F.lit(kind).alias("search"), "doc_id", score.alias("score"))
    full = postings.full_text(spark, index, "The, was").withColumnRenamed("id", "doc_id")
    found = [
        told(full, "full", F.round("rank", 9)),
        told(postings.keyword_search(docs, index, "sthe", "source", "text"), "keyword", F.round("score", 9)),
        told(postings.keyword_search(docs, index, "Ed Bo", "source", "text"), "two words", F.round("score", 9)),
        told(postings.like_top(docs.withColumn("path", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))), index, "SRC1", "path", "text"), "name", F.col("score")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _keyword(query: str, kind: str) -> str:
    n = len(query)
    return f"SELECT '{kind}' AS search, doc_id, round(CASE WHEN contains(lower(source), '{query}') THEN 0.6 ELSE 0 END + c / (c + 5) * 0.4::DOUBLE, 9)::DOUBLE AS score FROM (SELECT *, (length(lower(text)) - length(replace(lower(text), '{query}', ''))) / {n} AS c FROM documents WHERE contains(lower(text), '{query}') OR contains(lower(source), '{query}'))"


_INDEX = f"""
SELECT 'full' AS search, doc_id, rank::DOUBLE AS score FROM ({_FULL}) UNION ALL {_keyword("sthe", "keyword")} UNION ALL {_keyword("ed bo", "two words")}
UNION ALL SELECT * FROM (SELECT 'name' AS search, doc_id, 0.5::DOUBLE AS score FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'src1') ORDER BY source || '/' || lpad(doc_id::VARCHAR, 9, '0') LIMIT 20)
"""


def index_lines(spark, sf_dir):
    """How often each document has two words, and on which line first: from postings alone."""
    _, index = indexed(spark, sf_dir)
    return postings.first_lines(spark, index, "the; was").select("word", F.col("id").alias("doc_id"), "n", "first_line")


_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS k FROM documents
), w AS (SELECT doc_id, k, unnest(regexp_extract_all(line, '[\p{L}\p{Nd}]+')) AS word FROM l)
SELECT word, doc_id, count(*)::BIGINT AS n, min(k)::INT AS first_line FROM w WHERE word IN ('the', 'was') GROUP BY 1, 2
"""


QUERIES = {
    "index_search": (index_search, _INDEX),
    "index_lines": (index_lines, _LINES),
}
