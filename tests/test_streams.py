from datetime import date

from pyspark.sql import functions as F
from tessera.plans import streams
from tessera.streaming import incremental, keyed, rotation

MIN = 60_000
SF = "/root/testdata/sf0.001"


def fed(spark, folder, rows, ddl):
    """A stream of one batch for each list of rows, in order."""
    for own in rows:
        spark.createDataFrame(own, ddl).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.createDataFrame([], ddl).withColumn("ts", F.timestamp_millis("ms")).drop("ms").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def files_of(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("period=*/batch=*"))


def test_rotated_log_replaces_batches_and_drops_periods(spark, tmp_path):
    log = tmp_path / "log"
    put = rotation.rotating_sink(f"file://{log}", "daily", 2)
    batch = lambda *days: spark.createDataFrame([(f"2024-03-{d:02d} 10:00:00", f"line {d}") for d in days], "ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    read = lambda: sorted((r["period"].day, r["line"]) for r in rotation.rotated_log(spark, f"file://{log}", "ts timestamp, line string").collect())
    put(batch(1, 2), 0)
    put(batch(2, 3), 1)
    before = read()
    put(batch(2, 3), 1)
    assert read() == before == [(1, "line 1"), (2, "line 2"), (2, "line 2"), (3, "line 3")]
    assert files_of(log) == ["period=2024-03-01/batch=0", "period=2024-03-02/batch=0", "period=2024-03-02/batch=1", "period=2024-03-03/batch=1"]
    put(batch(4), 2)
    assert [p for p, _ in read()] == [2, 2, 3, 4]
    put(batch().limit(0), 3)
    put(batch(1), 4)  # late, and beyond the retention
    assert [p for p, _ in read()] == [2, 2, 3, 4]
    assert rotation.drop_expired(spark, f"file://{log}", date(2025, 1, 1), 2) == [date(2024, 3, 2), date(2024, 3, 3)]
    assert rotation.drop_expired(spark, f"file://{tmp_path}/none", date(2025, 1, 1), 2) == []


def test_rows_without_time_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(None, "x")], "ts timestamp, line string")
    rotation.rotating_sink(f"file://{tmp_path}/log", "weekly", 5)(df, 0)
    assert [r["period"] for r in rotation.rotated_log(spark, f"file://{tmp_path}/log", "ts timestamp, line string").collect()] == [date(1970, 1, 1)]
    one = spark.range(1).select(F.to_timestamp(F.lit("2024-03-05 07:08:09")).alias("t"))
    got = one.select(rotation.plain_line(F.col("t"), F.lit("info"), F.lit("job"), F.lit("a 100%")), rotation.structured_line(F.col("t"), F.lit("info"), F.lit("job"), F.lit('say "x"')), rotation.period_of(F.col("t"), 7)).first()
    assert got[0] == "2024-03-05 07:08:09 [info] [job] a 100%\n"
    assert got[1] == '{"time":"2024-03-05T07:08:09Z","level":"info","category":"job","message":"say \\"x\\""}\n'
    assert got[2] == date(2024, 2, 29)


CHUNKS = "chat string, ms long, seq int, content string, done boolean, prompt_tokens long, completion_tokens long, error string"


def test_chunks_are_put_together(spark, tmp_path):
    c = lambda chat, at, seq, text, done=None, p=None, q=None, error=None: (chat, at * MIN, seq, text, done, p, q, error)
    batches = [
        [c("a", 2, 1, "lo "), c("a", 1, 0, "hel"), c("b", 1, 0, "left "), c("f", 1, 0, "gone"), c("f", 2, None, "", error="z failed"), c("f", 2, None, "", error="failed")],
        [c("a", 2, 1, "LO"), c("a", 3, 3, "!", True, 7, 4), c("b", 2, 2, "open"), c("n", 3, None, "no number"), c("e", 3, 0, None, True)],
        [c("a", 4, 2, "you"), c("a", 4, 9, "beyond the end")],
        [c("a", 4, 2, "again"), c("z", 60, 0, "late ")],
        [c("b", 1, 0, "a repeat, late")],
    ]
    stream = fed(spark, tmp_path / "in", batches, CHUNKS)
    out = incremental.drained(keyed.reassembled(stream, "chat", timeout_ms=5 * MIN, late="10 minutes"), spark, "append")
    got = {r["chat"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": ("hello you!", 4, 7, 4, "done"), "b": ("left open", 2, 0, 0, "timeout"), "f": ("failed", 0, 0, 0, "error"), "e": ("", 1, 0, 0, "done"), "n": ("", 0, 0, 0, "timeout")}
    assert out.count() == len(got)


def test_many_answers_share_the_groups_of_the_state(spark, tmp_path):
    """300 keys in 8 groups: each is closed as it would be alone, and the state has a row a group."""
    kinds = "chat long, " + CHUNKS.split(", ", 1)[1]
    first, second, want = [], [], {}
    for chat in [None, *range(300)]:
        n, k = 1 + (chat or 0) % 5, (chat or 0) % 4
        rows = [(chat, (1 + i) * MIN, i, f"{chat}.{i} ", k < 2 and i == n - 1, chat, 2, "failed" if k == 1 and i == n - 1 else None) for i in range(n)]
        first += rows[1:] + rows[-1:]
        second += rows[:1] + [(chat, 1 * MIN, 0, "a repeat", False, None, None, None)]
        text = "".join(r[3] for r in rows)
        how = "done" if k == 0 else "error" if k == 1 else "timeout"
        want[chat] = ("failed", 0, 0, 0, how) if k == 1 else (text, n, *((chat or 0, 2) if k == 0 else (0, 0)), how)
    stream = fed(spark, tmp_path / "in", [first, second, [(1000, 60 * MIN, 0, "late", False, 0, 0, None)]], kinds)
    out = keyed.reassembled(stream, "chat", timeout_ms=5 * MIN, buckets=8)
    query = out.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("answers")
    assert got.schema["chat"].dataType.simpleString() == "bigint" and got.count() == len(want)
    assert {r["chat"]: tuple(r)[1:] for r in got.collect()} == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 8


def test_a_batch_is_a_slot_however_many_files_it_has(spark):
    day = F.timestamp_seconds(F.col("event_id") * 86_400 + F.unix_seconds(F.to_timestamp(F.lit("2024-01-01"))))
    rows = spark.range(30, numPartitions=2).select(F.col("id").alias("event_id"), day.alias("ts"))
    stream = streams._late(spark, SF, F.lit(False), rows=rows, files=3)
    batches = {}
    keep = lambda batch, k: batches.update({k: sorted(r["event_id"] for r in batch.collect())})
    stream.writeStream.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert batches == {k: list(range(30))[8 * k : 8 * k + 8] for k in range(4)}


def test_runs_follow_event_time(spark, tmp_path):
    line = lambda key, at, text, order=0: (key, at * MIN, order, text)
    batches = [
        [line("u", 5, "b"), line("u", 2, "a"), line("u", 1, "a")],
        [line("u", 3, "a"), line("u", 4, "a", 1), line("u", 4, "x", 2), line("v", 4, "q")],
        [line("u", 6, "b"), line("w", 30, "c")],
        [line("w", 31, "d"), line("w", 200, "d")],
    ]
    stream = fed(spark, tmp_path / "in", batches, "k string, ms long, o long, line string")
    out = incremental.drained(keyed.runs_in_order(stream, "k", order="o", late="10 minutes", idle_ms=60 * MIN), spark, "append")
    assert sorted(map(tuple, out.collect())) == [("u", "a", 4), ("u", "b", 2), ("u", "x", 1), ("v", "q", 1), ("w", "c", 1), ("w", "d", 1)]
