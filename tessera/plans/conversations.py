"""Queries of conversations, code, pages, schedules and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import conversation, jobs
from tessera.plans import table
from tessera.sources.html import common, html_blocks


def exchange_pairs(spark, sf_dir):
    pairs = conversation.exchanges(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", F.col("exchange").cast("long").alias("exchange"), "turn", F.length("user_text").cast("long").alias("user_chars"), F.length("assistant_text").cast("long").alias("assistant_chars"))


_PAIRS = """WITH p AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS exchange, turn, length(text)::BIGINT AS user_chars, length(nt)::BIGINT AS assistant_chars FROM p WHERE role = 'user' AND nr = 'assistant'"""


def transcripts(spark, sf_dir):
    """The first two exchanges of each conversation, as text."""
    pairs = conversation.selected(conversation.exchanges(table(spark, sf_dir, "conversations")), 1, 2)
    return conversation.transcript(pairs).select("conv_id", F.sha2("transcript", 256).alias("transcript_sha256"))


_TRANSCRIPT = """WITH p AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), e AS (SELECT conv_id, text, nt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, sha256(string_agg('### You' || chr(10) || chr(10) || text || chr(10) || chr(10) || '### Assistant' || chr(10) || chr(10) || nt || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS transcript_sha256 FROM e WHERE n <= 2 GROUP BY 1"""


def history_trim(spark, sf_dir):
    """The last four turns of each conversation, with the system message apart."""
    turns = conversation.system_apart(table(spark, sf_dir, "conversations"))
    return conversation.recent_history(turns.where("not is_system"), 4).select("conv_id", "turn", "role")


_HISTORY = """WITH s AS (SELECT *, role = 'system' AND row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) = 1 AS sys FROM conversations)
SELECT conv_id, turn, role FROM s WHERE NOT sys QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"""


def last_exchange(spark, sf_dir):
    out = conversation.last_exchange(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.sha2(F.concat("user_text", F.lit("|"), "assistant_text"), 256).alias("sha256"))


_LAST = """WITH p AS (SELECT *, lag(role) OVER w AS br, lag(text) OVER w AS bt, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, sha256(bt || '|' || text) AS sha256 FROM p WHERE k = 1 AND role = 'assistant' AND br = 'user'"""


def _fenced(spark, sf_dir):
    """Turns of even number inside a fence, every fourth of those a memory fence, after a line of their own."""
    fence = F.when(F.col("turn") % 4 == 0, "```memory").otherwise("```py")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see\n"), fence, F.lit("\n"), "text", F.lit("\n```\ndone"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))


def code_blocks(spark, sf_dir):
    out = conversation.code_blocks(_fenced(spark, sf_dir), "id")
    return out.select("id", F.col("block_ord").cast("long").alias("block_ord"), F.sha2("code", 256).alias("code_sha256"))


_CODE = "SELECT conv_id * 1000 + turn AS id, 0::BIGINT AS block_ord, sha256(rtrim(text, chr(10))) AS code_sha256 FROM conversations WHERE turn % 4 = 2"


def strip_code(spark, sf_dir):
    out = conversation.strip_code(_fenced(spark, sf_dir))
    return out.select("id", F.sha2("text", 256).alias("text_sha256"))


_STRIP = "SELECT conv_id * 1000 + turn AS id, sha256(CASE WHEN turn % 2 = 0 THEN 'see' || chr(10) || 'done' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END) AS text_sha256 FROM conversations"


def detect_language(spark, sf_dir):
    """Documents behind a line of code chosen by their id: the language told, and whether they look like code."""
    lines = ["func main() { fmt.Println(x := 1) }", "def f(self): print(None)", "SELECT a FROM b WHERE c", "const a = () => { return 1 }"]
    head = F.get(F.array(*[F.lit(x) for x in lines]), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.replace(F.translate("text", "#*$%&|<>=:;{}", ""), F.lit("import"), F.lit(""))).alias("text"))
    return conversation.with_likely_code(docs).select("doc_id", conversation.language(F.col("text")).alias("language"), "likely_code")


_LANGUAGE = """
WITH t AS (SELECT doc_id, ['func main() { fmt.Println(x := 1) }', 'def f(self): print(None)', 'SELECT a FROM b WHERE c', 'const a = () => { return 1 }'][(doc_id % 4 + 1)::INT] || chr(10) || replace(translate(text, '#*$%&|<>=:;{}', ''), 'import', '') AS text FROM documents
), s AS (SELECT doc_id, text, [CASE WHEN true THEN 0 END] AS z,
  contains(text, 'package ')::INT + contains(text, 'func ')::INT + contains(text, ':=')::INT + contains(text, 'import (')::INT + contains(text, 'fmt.')::INT + contains(text, 'chan ')::INT AS go,
  contains(text, 'def ')::INT + contains(text, 'import ')::INT + contains(text, 'elif ')::INT + contains(text, 'self.')::INT + contains(text, 'print(')::INT + contains(text, 'None')::INT + contains(text, 'True')::INT + contains(text, 'False')::INT AS py,
  contains(text, 'fn ')::INT + contains(text, 'let mut')::INT + contains(text, 'impl ')::INT + contains(text, 'match ')::INT AS rs,
  contains(text, 'fun ')::INT + contains(text, 'val ')::INT + contains(text, 'var ')::INT + contains(text, 'println(')::INT AS kt,
  contains(text, 'const ')::INT + contains(text, 'let ')::INT + contains(text, '=>')::INT + contains(text, 'function ')::INT AS js,
  contains(text, 'SELECT ')::INT + contains(text, 'FROM ')::INT + contains(text, 'WHERE ')::INT AS sq FROM t
), g AS (SELECT *, greatest(go, py, rs, kt, js, sq) AS m FROM s
), c AS (SELECT doc_id, len(list_filter(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: regexp_matches(x, '[;{}]\\s*$|^\\s*(//|/\\*|#!)|:=|==|!=|const |let |var |import |function|return '))) AS n,
  len(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))) AS l FROM t)
SELECT doc_id, CASE WHEN go = m THEN 'go' WHEN py = m THEN 'python' WHEN rs = m THEN 'rust' WHEN kt = m THEN 'kotlin' WHEN js = m THEN 'javascript' ELSE 'sql' END AS language, n >= 3 OR n / l >= 0.35 AS likely_code FROM g JOIN c USING (doc_id)
"""


def html_text(spark, sf_dir):
    """The blocks of all pages, the commonest character references resolved."""
    blocks = html_blocks(table(spark, sf_dir, "pages"), resolve=common)
    return blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if("bold").alias("headings"), F.sum(F.length("text")).alias("chars"))


def html_references(spark, sf_dir):
    """The blocks of all pages with all character references resolved, as one digest a page."""
    blocks = html_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))
    return blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(F.array_sort(F.collect_list("text")), "\n"), 256).alias("texts_sha256"))


_HTML = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g') AS h FROM pages
), m AS (SELECT page_id, string_split(regexp_replace('<p>' || h, '(?is)<(/?)(h1|h2|h3|p|li|br|div)[^>]*>', chr(1) || '\1\2' || chr(1), 'g'), chr(1)) AS p FROM b
), s AS (SELECT page_id, i, lower(p[2 * i]) AS tag, trim(regexp_replace(p[2 * i + 1], '(?s)<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (SELECT page_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM m)
), o AS (SELECT *, last_value(CASE WHEN NOT starts_with(tag, '/') THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS open FROM s
), u AS (SELECT page_id, open, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM o WHERE t <> '')
SELECT page_id, count(*)::BIGINT AS blocks, count(*) FILTER (open IN ('h1', 'h2', 'h3'))::BIGINT AS headings, sum(length(t))::BIGINT AS chars FROM u GROUP BY 1
"""

SCHEDULES = {"night": "0 2 * * *", "quarter": "*/15 9-17 * * 1-5", "either": "30 * 13 * 5", "broken": "61 * * * *"}


def cron_due(spark, sf_dir):
    """Minutes of the events, and the schedules that are due in them."""
    minutes = table(spark, sf_dir, "events").select(F.date_trunc("minute", "ts").alias("ts")).distinct()
    return jobs.due_jobs(minutes, SCHEDULES).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "job")


_CRON = """
WITH m AS (SELECT DISTINCT date_trunc('minute', ts) AS t FROM events), p AS (SELECT t, minute(t) AS mi, hour(t) AS h, day(t) AS d, dayofweek(t) AS w FROM m)
SELECT strftime(t, '%Y-%m-%d %H:%M') AS minute, job FROM (
  SELECT t, 'night' AS job FROM p WHERE mi = 0 AND h = 2 UNION ALL SELECT t, 'quarter' FROM p WHERE mi % 15 = 0 AND h BETWEEN 9 AND 17 AND w BETWEEN 1 AND 5
  UNION ALL SELECT t, 'either' FROM p WHERE mi = 30 AND (d = 13 OR w = 5))
"""


def humanized_schedules(spark, sf_dir):
    """A schedule made of each event's time, in words."""
    e = table(spark, sf_dir, "events")
    part = lambda c, k: F.when(F.col("event_id") % k == 0, "*").otherwise(c.cast("string"))
    cron = F.concat_ws(" ", F.minute("ts").cast("string"), part(F.hour("ts"), 5), part(F.dayofmonth("ts"), 2), F.lit("*"), part(F.dayofweek("ts") - 1, 3))
    return e.select("event_id", cron.alias("cron"), jobs.humanized(cron).alias("words"))


_HUMAN = """
WITH c AS (SELECT event_id, minute(ts) AS m, CASE WHEN event_id % 5 = 0 THEN '*' ELSE hour(ts)::VARCHAR END AS h, CASE WHEN event_id % 2 = 0 THEN '*' ELSE day(ts)::VARCHAR END AS d, CASE WHEN event_id % 3 = 0 THEN '*' ELSE dayofweek(ts)::VARCHAR END AS w FROM events)
SELECT event_id, m || ' ' || h || ' ' || d || ' * ' || w AS cron,
  CASE WHEN h = '*' AND d = '*' AND w = '*' THEN 'Every hour, at minute ' || m
    WHEN h <> '*' AND d = '*' AND w = '*' THEN 'Daily at ' || lpad(h, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0')
    WHEN h <> '*' AND d = '*' THEN 'Weekly on ' || ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][w::INT + 1] || ' at ' || lpad(h, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0')
    WHEN h <> '*' AND w = '*' THEN 'Monthly on day ' || d || ' at ' || lpad(h, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0')
    ELSE m || ' ' || h || ' ' || d || ' * ' || w END AS words FROM c
"""


def log_filter(spark, sf_dir):
    """Events as log lines: levels by id, types as categories; warnings and above of two categories."""
    e = table(spark, sf_dir, "events")
    level = F.get(F.array(*[F.lit(x) for x in jobs.LEVELS]), (F.col("event_id") % 4).cast("int"))
    logs = e.select("event_id", level.alias("level"), F.col("event_type").alias("category"))
    return jobs.log_filter(logs, "warn", {"purchase": True, "click": True, "view": False})


_LOG = "SELECT event_id, ['debug', 'info', 'warn', 'error'][(event_id % 4 + 1)::INT] AS level, event_type AS category FROM events WHERE event_id % 4 >= 2 AND event_type IN ('purchase', 'click')"


def log_retention(spark, sf_dir):
    """A log file per user and day of its events: what is older than seven days before the last event."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("last_day"))
    files = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("name")).distinct()
    return jobs.expired_logs(files.join(F.broadcast(last)), F.col("last_day"), 7).drop("last_day")


_RETENTION = "SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') || '.log' AS name, ts::DATE < (SELECT max(ts)::DATE - 7 FROM events) AS expired FROM events"

QUERIES = {
    "exchange_pairs": (exchange_pairs, _PAIRS),
    "transcripts": (transcripts, _TRANSCRIPT),
    "history_trim": (history_trim, _HISTORY),
    "last_exchange": (last_exchange, _LAST),
    "code_blocks": (code_blocks, _CODE),
    "strip_code": (strip_code, _STRIP),
    "detect_language": (detect_language, _LANGUAGE),
    "html_text": (html_text, _HTML),
    "html_references": (html_references, None),
    "cron_due": (cron_due, _CRON),
    "humanized_schedules": (humanized_schedules, _HUMAN),
    "log_filter": (log_filter, _LOG),
    "log_retention": (log_retention, _RETENTION),
}
