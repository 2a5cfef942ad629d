from pyspark.sql import functions as F
from tessera.llm import mixing, oracles, queries


def test_query_matches_sql(spark, duck, same):
    same(queries.op6_mix_sources(spark, "/root/testdata/sf0.001"), duck, oracles.OP6)


def level(sizes):
    """Targets by giving out what is over, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        for s in free:
            target[s] = left * weight[s] / total
        if not over:
            return target
        for s in over:
            target[s] = 3 * sizes[s]
            capped.add(s)
            left -= 3 * sizes[s]


def test_targets_are_levelled(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 400, None: 30, "e": 0}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = level(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6


def test_messy_documents(messy):
    pieces, docs = mixing.mix(messy)
    rows = docs.collect()
    assert len(rows) == messy.count()
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert pieces.agg(F.sum("n_tokens")).first()[0] == sum(r["taken"] for r in rows)
    assert pieces.where("n_tokens <= 0").count() == 0
    again = mixing.mix(messy.repartition(5))[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_slots_of_a_source_are_spread(spark):
    goals = spark.createDataFrame([(0, 100), (1, 300), (2, 600)], "source_no int, quota long")
    slots = mixing.schedule(mixing.shares(goals, 8), 8).orderBy("slot").collect()
    n = len(slots)
    assert [s["slot"] for s in slots] == list(range(n)) and n == 256
    for no, share in ((0, 0.1), (1, 0.3), (2, 0.6)):
        for upto in (n // 8, n // 2, n):
            assert abs(sum(1 for s in slots[:upto] if s["source_no"] == no) - share * upto) < 4
        assert [s["rank"] for s in slots if s["source_no"] == no] == list(range(sum(1 for s in slots if s["source_no"] == no)))


def test_the_schedule_decides(messy, monkeypatch):
    """Fewer slots: what is taken follows from whole blocks; another sequence: documents come from other slots."""
    rows = [r.asDict() for r in mixing.mix(messy, slots_per_source=4)[1].collect()]
    block = -(-sum(r["size"] for r in rows) // 16)
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        taken = sum(r["taken"] for r in own)
        assert taken == round(own[0]["target"]) or taken % block == 0
        assert own[0]["target"] - block - 1 <= taken <= own[0]["target"] + 1
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
    monkeypatch.setattr(mixing, "mirrored", lambda i, bits: i)
    other = [r.asDict() for r in mixing.mix(messy, slots_per_source=4)[1].collect()]
    assert sorted(str(r) for r in other) != sorted(str(r) for r in rows)


def test_empty_table_and_tables_without_words(spark, empty):
    assert mixing.mix(empty)[1].count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in mixing.mix(blank)[1].collect()} == {(0, 0.0)}
