"""Queries that run as streams over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.jobs import log_filter
from tessera.plans import table
from tessera.plans.conversations import _CRON, SCHEDULES
from tessera.shipping import materialize, shared_dir, ship
from tessera.streaming import incremental, keyed, rotation


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def spend_stream(spark, sf_dir):
    """Daily purchases per user."""
    events = _events(spark, sf_dir).where("event_type = 'purchase'").withColumn("usd", F.round("value", 2).cast("decimal(18,2)"))
    out = incremental.drained(incremental.spend_stream(events, "user_id"), spark, "complete")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("usd").cast("double").alias("usd"), "n")


def run_collapse_stream(spark, sf_dir):
    """Closed runs of equal event types per user."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type")
    lines = _events(spark, sf_dir).select("user_id", "ts", "event_id", line.alias("line"))
    return incremental.drained(incremental.closed_runs(lines, "user_id", ["ts", "event_id"]), spark, "append")


_RUNS = r"""
WITH l AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) AS g FROM l
), s AS (SELECT user_id, event_type, g, min(k) AS a, arg_min(line, k) AS first, count(*)::BIGINT AS n FROM r GROUP BY 1, 2, 3)
SELECT user_id, first, n FROM s QUALIFY a < max(a) OVER (PARTITION BY user_id)
"""


def cron_stream(spark, sf_dir):
    """The schedules due at the minutes of the events."""
    due = incremental.due_stream(_events(spark, sf_dir).select("ts"), SCHEDULES)
    return incremental.drained(due, spark, "append").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "job").distinct()


SLOT_DAYS, SLOTS, SLOT_FILES = 8, 4, 8


def _late(spark, sf_dir, late, slots=1, twice=None, rows=None, files=1):
    """The events, or rows made of them, as a stream of SLOTS batches of SLOT_DAYS each, written by as many tasks as a batch has files; those of `late` come `slots` batches later than their own, and those of `twice` once more in the next."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.min(F.col("ts").cast("date")).alias("first"))
    events = events if rows is None else rows
    slot = F.least(F.col("own") + F.when(late, slots).otherwise(0), F.lit(SLOTS - 1))
    more = F.least(slot + 1, F.lit(SLOTS - 1))
    times = F.when(F.lit(False) if twice is None else twice, F.array(slot, more)).otherwise(F.array(slot))
    own = F.floor(F.datediff("ts", "first") / SLOT_DAYS)
    rows = events.join(F.broadcast(first)).withColumn("own", own).withColumn("slot", F.explode(times)).drop("first", "own")
    folder = f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    written = lambda: spark.read.schema(events.schema).parquet(folder)
    rows.persist()
    for k in range(SLOTS):  # one after the other: a stream takes the oldest files first
        rows.where(F.col("slot") == k).drop("slot").coalesce(files).write.mode("append").parquet(folder)
        for _ in range(files * (k + 1) - len(written().inputFiles())):  # tasks without rows leave no file
            written().limit(0).write.mode("append").parquet(folder)
    rows.unpersist()
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


#: Of the SQL twins: milliseconds of the newest event; a delay of 17 days is more than any row is late.
_NEWEST = "w AS (SELECT epoch_ms(max(ts)) AS newest FROM events)"
_LATE, _LATE_MS = "17 days", 17 * 86_400_000


def log_rotation(spark, sf_dir):
    """Events as a log in weeks, kept for 14 days, of level info or above; the rows of several batches out of order, every batch put twice."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").otherwise("info")
    events = _late(spark, sf_dir, F.col("event_id") % 3 == 0).withColumn("level", level)
    line = rotation.plain_line(F.col("ts"), F.col("level"), F.col("event_type"), F.concat(F.lit("user "), "user_id"))
    logs = log_filter(events, "info").select("ts", "event_id", line.alias("line"))
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    put = rotation.rotating_sink(f"{base}/log", "weekly", 14)

    def twice(batch, number):
        put(batch, number)
        put(batch, number)

    logs.writeStream.foreachBatch(twice).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = rotation.rotated_log(spark, f"{base}/log", "ts timestamp, event_id long, line string")
    ends = [f(F.struct("ts", "event_id", "line"))["line"].alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return rows.groupBy(F.date_format("period", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("lines"), *ends, F.sum(F.length("line")).alias("chars"))


_ROTATION = """
WITH l AS (SELECT ts, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END AS level, event_type, user_id,
  DATE '1970-01-01' + (7 * (datediff('day', DATE '1970-01-01', ts::DATE) // 7))::INT AS period FROM events
), k AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || level || '] [' || event_type || '] user ' || user_id || chr(10) AS line FROM l WHERE level <> 'debug'
), n AS (SELECT max(ts)::DATE AS now, max(period) AS newest FROM k)
SELECT strftime(period, '%Y-%m-%d') AS period, count(*)::BIGINT AS lines, arg_min(line, (ts, event_id)) AS first, arg_max(line, (ts, event_id)) AS last, sum(length(line))::BIGINT AS chars
FROM k, n WHERE period >= now - 14 OR period = newest GROUP BY 1
"""


def chunk_stream(spark, sf_dir):
    """Answers in chunks, one event each, of a user's day: out of order, some twice, some lost; every fourth user's have no end."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ship(spark)
    chat = F.concat("user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    order = Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id")
    numbered = events.withColumn("chat", chat).withColumns({"seq": F.row_number().over(order) - 1, "last": F.lead(F.lit(1)).over(order).isNull()})
    chunks = numbered.where(~((F.col("user_id") % 7 == 1) & (F.col("seq") == 1)))
    chunks = chunks.select("event_id", "chat", "ts", "seq", F.concat("event_type", F.lit(" ")).alias("content"), (F.col("last") & (F.col("user_id") % 4 != 0)).alias("done"), F.col("event_id").alias("prompt_tokens"), F.round("value").cast("long").alias("completion_tokens"), F.when((F.col("user_id") % 11 == 3) & F.col("last"), "no model").alias("error"))
    # numbered once, before they are dealt to batches: none of these has to look them up
    chunks = _late(spark, sf_dir, F.col("event_id") % 3 == 0, twice=F.col("event_id") % 5 == 0, rows=materialize(chunks, "chunks"), files=SLOT_FILES)
    return incremental.drained(keyed.reassembled(chunks, "chat", timeout_ms=2 * 86_400_000, late=_LATE), spark, "append")


_CHUNKS = f"""
WITH {_NEWEST}, n AS (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS chat, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id, ts::DATE) AS whole FROM events
), c AS (SELECT *, user_id % 4 <> 0 AND seq = whole - 1 AS done, user_id % 11 = 3 AND seq = whole - 1 AS failed FROM n WHERE NOT (user_id % 7 = 1 AND seq = 1)
), a AS (SELECT chat, string_agg(event_type || ' ', '' ORDER BY seq) AS text, count(*)::INT AS chunks, coalesce(max(event_id) FILTER (done), 0)::BIGINT AS prompt_tokens,
  coalesce(max(round(value)) FILTER (done), 0)::BIGINT AS completion_tokens, bool_or(failed) AS failed, bool_or(done) AND count(*) = any_value(whole) AS ended, max(epoch_ms(ts)) AS last FROM c GROUP BY 1)
SELECT chat, CASE WHEN failed THEN 'no model' ELSE text END AS text, CASE WHEN failed THEN 0 ELSE chunks END::INT AS chunks, CASE WHEN failed THEN 0 ELSE prompt_tokens END::BIGINT AS prompt_tokens, CASE WHEN failed THEN 0 ELSE completion_tokens END::BIGINT AS completion_tokens,
  CASE WHEN failed THEN 'error' WHEN ended THEN 'done' ELSE 'timeout' END AS closed FROM a, w WHERE failed OR ended OR last + 2 * 86400000 < newest - {_LATE_MS}
"""


def run_order_stream(spark, sf_dir):
    """Closed runs of equal event types per user, from files that are not in the order of time."""
    ship(spark)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type")
    lines = _late(spark, sf_dir, F.col("event_id") % 3 == 0).select("user_id", "ts", "event_id", line.alias("line"))
    runs = keyed.runs_in_order(lines, "user_id", order="event_id", late=_LATE, idle_ms=3 * 86_400_000)
    return incremental.drained(runs, spark, "append")


_ORDERED = f"""
WITH {_NEWEST}, l AS (SELECT user_id, event_type, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type AS line FROM events, w WHERE epoch_us(ts) <= (newest - {_LATE_MS}) * 1000
), b AS (SELECT *, CASE WHEN lag(event_type) OVER o IS DISTINCT FROM event_type OR epoch_us(ts) - lag(epoch_us(ts)) OVER o > 3 * 86400000000 THEN 1 ELSE 0 END AS new FROM l WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b
), r AS (SELECT user_id, run, arg_min(line, (ts, event_id)) AS first, count(*)::BIGINT AS n, max(epoch_us(ts)) AS last FROM g GROUP BY 1, 2)
SELECT user_id, first, n FROM r, w QUALIFY run < max(run) OVER (PARTITION BY user_id) OR (newest - {_LATE_MS}) * 1000 - last > 3 * 86400000000
"""


def spend_append_stream(spark, sf_dir):
    """Daily purchases per user, each day given once the watermark has passed it; what comes three batches late is dropped."""
    events = _late(spark, sf_dir, (F.col("event_id") % 10 == 0) & (F.col("own") == 0), slots=3).where("event_type = 'purchase'").withColumn("usd", F.round("value", 2).cast("decimal(18,2)"))
    out = incremental.drained(incremental.spend_stream(events, "user_id", late="1 day"), spark, "append")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("usd").cast("double").alias("usd"), "n")


_APPENDED = f"""
WITH e AS (SELECT *, epoch_ms(ts) AS ms, datediff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {SLOT_DAYS} AS slot FROM events WHERE event_type = 'purchase'
), w AS (SELECT max(ms) - 86400000 AS mark FROM e), k AS (SELECT * FROM e WHERE NOT (event_id % 10 = 0 AND slot = 0))
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(round(value, 2)::DECIMAL(18,2))::DOUBLE AS usd, count(*)::BIGINT AS n FROM k, w GROUP BY 1, 2, mark HAVING epoch_ms(max(ts)::DATE + INTERVAL 1 DAY) <= mark
"""


def first_seen_stream(spark, sf_dir):
    """Types of events of a user's day, each once, however often and out of order they come."""
    events = _late(spark, sf_dir, F.col("event_id") % 3 == 0, twice=F.col("event_id") % 5 == 0)
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).select("ts", "user_id", "day", "event_type")
    return incremental.drained(incremental.first_seen(rows, ["user_id", "day", "event_type"], late=_LATE), spark, "append").select("user_id", "day", "event_type")


QUERIES = {
    "log_rotation": (log_rotation, _ROTATION),
    "chunk_stream": (chunk_stream, _CHUNKS),
    "run_order_stream": (run_order_stream, _ORDERED),
    "spend_append_stream": (spend_append_stream, _APPENDED),
    "first_seen_stream": (first_seen_stream, "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events"),
    "spend_stream": (spend_stream, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(round(value, 2)::DECIMAL(18,2))::DOUBLE AS usd, count(*)::BIGINT AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"),
    "run_collapse_stream": (run_collapse_stream, _RUNS),
    "cron_stream": (cron_stream, _CRON),
}
