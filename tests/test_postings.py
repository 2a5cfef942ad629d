import pytest
from pyspark.sql import functions as F
from tessera.operators import memory, postings, search

DOCS = [(1, "n1", "The cat; the DOG\nthe end"), (2, "cats", "Cathedral dog was"), (3, "n3", "dog CAT dog\n\ndog é9x"), (4, None, None), (5, "", ""), (6, "dog house", "a-b a b"), (7, "n7", "hot dog's end")]


@pytest.fixture
def index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, name string, text string")
    ix = postings.Index(f"file://{tmp_path}/ix", "id", ("name", "text"), 8)
    postings.add(docs.where("id < 5").unionByName(docs.where("id = 5").withColumn("text", F.lit("stale dog"))), ix, 0)
    postings.add(docs.where("id >= 5"), ix, 1)
    return docs, ix


def test_runs_of_a_query():
    assert postings.query_runs("a b-cd ") == [("a", True, False), ("b", False, False), ("cd", False, False)]
    assert postings.query_runs("é9x") == [("é9x", True, True)] and postings.query_runs(" ,;") == []


def test_searches_by_the_index_give_what_the_texts_give(spark, index):
    docs, ix = index
    for q in ("dog", "cat", "at", "he ", " e", "a b", "-", "g c", "dog\n", "none", "og's e", "é9", "THE", "s", "a-b"):
        want = {r["id"]: (round(r["score"], 9), r["line"]) for r in search.keyword_search(docs, q, "name", "text").collect()}
        got = postings.keyword_search(docs, ix, q, "name", "text").collect()
        assert {r["id"]: (round(r["score"], 9), r["line"]) for r in got} == want, q
        assert [(-r["score"], r["id"]) for r in got] == sorted((-r["score"], r["id"]) for r in got)
        assert [r["id"] for r in postings.like_top(docs, ix, q, "name", "text").collect()] == [r["id"] for r in search.like_top(docs, q, "name", "text").collect()], q
    for q in ("dog", "cat dog", "the dog", "none", " ,", "stale"):
        want = [(r["id"], round(r["rank"], 9)) for r in memory.full_text(docs, q, "text", "id").collect()]
        assert [(r["id"], round(r["rank"], 9)) for r in postings.full_text(spark, ix, q).collect()] == want, q


def test_a_search_reads_the_buckets_of_its_words(spark, index):
    _, ix = index
    plan = postings.postings(spark, ix, ["dog"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "EqualTo(word,dog)" in plan
    lines = {(r["word"], r["id"]): (r["n"], r["first_line"]) for r in postings.first_lines(spark, ix, "the end").collect()}
    assert lines == {("the", 1): (3, 1), ("end", 1): (1, 2), ("end", 7): (1, 1)}


def test_a_generation_written_again_replaces_itself(spark, index):
    docs, ix = index
    before = sorted(map(str, postings.postings(spark, ix).collect()))
    postings.add(docs.where("id >= 5"), ix, 1)
    assert sorted(map(str, postings.postings(spark, ix).collect())) == before
    postings.add(docs.where("id = 7").withColumn("text", F.lit("gone")), ix, 2)
    assert [r["id"] for r in postings.full_text(spark, ix, "dog").collect()] == [3, 1, 2]
