import re

from tessera.llm import oracles, quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(w) < 2000 else None
    lines = [s for s in t.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_query_matches_sql(spark, duck, same):
    same(queries.op8_quality_rules(spark, "/root/testdata/sf0.001"), duck, oracles.OP8)


def test_messy_documents_match_brute_force(messy):
    rows = quality.quality_report(messy).collect()
    assert len(rows) == messy.count()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"] if r["n_words"] < 2000 else None) for r in rows), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in messy.collect()), key=str)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_ledger_replaces_clashing_columns_and_filters_do_not_remeasure(messy):
    rows = quality.ledger(messy)
    assert rows.columns.count("n_words") == 1
    assert rows.where(quality.kept(quality.BASE)).count() == sum(1 for r in quality.quality_report(messy).collect() if not r["base_failed"])


def test_policies_and_ablation(messy):
    report = quality.quality_report(messy)
    rows = report.collect()
    table = {r["rule"]: r for r in quality.ablation(report).collect()}
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert table[rule.name]["n_failed"] == sum(1 for r in rows if r["fail_bits"] & bit)
        assert table[rule.name]["n_only"] == sum(1 for r in rows if r["fail_bits"] & quality.mask(quality.STANDARD) == bit)


def test_empty_table(empty):
    assert quality.quality_report(empty).count() == 0
    assert {r["n_failed"] for r in quality.ablation(quality.quality_report(empty)).collect()} == {0}
