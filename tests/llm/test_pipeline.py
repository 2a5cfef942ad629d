import corpus_pipeline as P
import pytest
from tessera.llm import quality, suffix_dedup
from test_decontaminate import brute as contaminated_by
from test_near_copies import brute_keep


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    out["input"] = docs.collect()
    for i, (name, f) in enumerate(P.STAGES):
        from tessera.llm.common import materialize

        docs = materialize(f(spark, docs, d), f"test-{i}")
        out[name] = docs.collect()
    return out


def test_quality_rules(stages, spark):
    kept = {r["doc_id"] for r in quality.quality_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in stages["quality_rules"]} == kept and len(stages["quality_rules"]) == len(kept) < len(stages["input"])


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality_rules"]]
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted(i for _, i in brute_keep(rows))


def test_repeated_passages_go(stages):
    before = {r["doc_id"]: r for r in stages["near_duplicates"]}
    after = {r["doc_id"]: r for r in stages["substring_dedup"]}
    assert before.keys() == after.keys()
    wanted = suffix_dedup.brute_force([r["text"].encode() for r in before.values()])
    for (i, r), (removed, _, _) in zip(before.items(), wanted, strict=True):
        left = len(r["text"].encode()) - removed
        assert left - 6 <= len(after[i]["text"].encode()) <= left
        assert after[i]["n_chars"] == (len(after[i]["text"]) if removed else r["n_chars"])
    assert any(x[0] for x in wanted)


def test_contaminated_documents_go(stages, spark):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r["doc_id"] for r in stages["substring_dedup"] if not contaminated_by(r["text"], items)[3]}
    assert {r["doc_id"] for r in stages["benchmark_decontamination"]} == clean


def test_mix_meets_targets(stages):
    by: dict = {}
    for r in stages["mix_sources"]:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert len(stages["mix_sources"]) == len(stages["benchmark_decontamination"])
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


def test_stages_take_odd_documents(spark, messy, empty):
    d = "/root/testdata/sf0.001"
    for _, f in P.STAGES:
        assert f(spark, messy, d).count() > 0
        assert f(spark, empty, d).count() == 0


def test_columns(spark, empty):
    for _, f in P.STAGES[:-1]:
        assert f(spark, empty, "/root/testdata/sf0.001").columns == P.COLUMNS
