"""Queries of memory, knowledge and projects as tables, of saves and deletes, and of contexts told once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assembly, memory, writes
from tessera.plans import table

_FIRST = "2024-01-01"


def memory_table(spark, sf_dir):
    """Documents as memory: a project for each source, a session day and a moment by id, every third archived."""
    docs = table(spark, sf_dir, "documents")
    day = F.date_add(F.to_date(F.lit(_FIRST)), (F.col("doc_id") % 400).cast("int"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") * 37) % 100_003)
    return docs.select(F.col("source").alias("project"), F.col("text").alias("content"), day.alias("session_date"), at.alias("created_at"), (F.col("doc_id") % 3 == 0).alias("archived"))


_MEMORY = f"m AS (SELECT source AS project, text AS content, DATE '{_FIRST}' + (doc_id % 400)::INT AS session_date, (doc_id * 37) % 100003 AS created_at, doc_id % 3 = 0 AS archived FROM documents)"


def memory_recent(spark, sf_dir):
    """The newest fifty entries of each project that are not archived, as one text."""
    return memory.recent(memory_table(spark, sf_dir)).select("project", F.sha2("text", 256).alias("text_sha256"))


_RECENT = f"""
WITH {_MEMORY}, r AS (SELECT project, content, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, content) AS n FROM m WHERE NOT archived)
SELECT project, sha256(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS text_sha256 FROM r WHERE n <= 50 GROUP BY 1
"""


def memory_everything(spark, sf_dir):
    """All entries with the marks of archived ones, after those of sessions over 200 days before the end of 2024 were archived."""
    old = memory.archived_before(memory_table(spark, sf_dir), F.to_timestamp(F.lit("2024-12-31")), 200)
    return memory.everything(old).select("project", F.col("session_date").cast("string").alias("session_date"), F.sha2("text", 256).alias("text_sha256"))


_EVERYTHING = f"WITH {_MEMORY} SELECT project, session_date::VARCHAR AS session_date, sha256(CASE WHEN archived OR session_date < DATE '2024-12-31' - 200 THEN '<!-- archived -->' || chr(10) ELSE '' END || content) AS text_sha256 FROM m"


def memory_insert(spark, sf_dir):
    """What assistants said as new entries of a day."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    entries = turns.select(F.col("conv_id").cast("string").alias("project"), F.concat(F.lit("\n  "), "text", F.lit(" \n")).alias("content"))
    rows = memory.inserted(entries, F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    return rows.select("project", F.col("session_date").cast("string").alias("session_date"), "archived", F.sha2("content", 256).alias("content_sha256"))


_INSERT = "SELECT conv_id::VARCHAR AS project, '2024-05-06' AS session_date, false AS archived, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS content_sha256 FROM conversations WHERE role = 'assistant'"


def knowledge_table(spark, sf_dir):
    """Every name of every domain, in German: active rows of that language or of none."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string"))
    have = docs.select(F.lit("skill").alias("kind"), F.col("source").alias("domain"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("lang"), name.alias("name"), F.col("text").alias("content"), (F.col("doc_id") % 5 == 0).alias("is_custom"), (F.col("doc_id") % 7 != 0).alias("active"))
    wanted = have.select("kind", "domain", "name").distinct().withColumn("lang", F.lit("de"))
    return memory.knowledge_rows(have, wanted).select("domain", "name", F.sha2("content", 256).alias("content_sha256"))


_KNOWLEDGE = """
WITH k AS (SELECT source AS domain, 'n' || doc_id % 50 AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS lang, text, doc_id % 5 = 0 AS custom FROM documents WHERE doc_id % 7 <> 0)
SELECT domain, name, sha256(text) AS content_sha256 FROM k WHERE lang IN ('de', '')
QUALIFY row_number() OVER (PARTITION BY domain, name ORDER BY lang <> 'de', NOT custom, text) = 1
"""


def project_table(spark, sf_dir):
    """Suppliers as projects, every fifth not active, with tasks by nation; those of every eleventh cannot be read."""
    s = table(spark, sf_dir, "supplier")
    tasks = F.when(F.col("s_suppkey") % 11 == 0, "{").otherwise(F.concat(F.lit('{"t'), (F.col("s_nationkey") % 3).cast("string"), F.lit('": {"prompt": "p"}, "audit": {}}')))
    rows = s.select(F.col("s_name").alias("name"), F.to_json(F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("variables"), tasks.alias("tasks"), (F.col("s_suppkey") % 5 != 0).alias("active"))
    out = memory.active_projects(rows)
    return out.select("name", F.col("variables")["nation"].alias("nation"), F.array_join("task_names", ",").alias("task_names"))


_PROJECTS = "SELECT s_name AS name, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'audit,t' || s_nationkey % 3 END AS task_names FROM supplier WHERE s_suppkey % 5 <> 0"


def full_text_search(spark, sf_dir):
    """The twenty documents of highest rank with both words of a query."""
    out = memory.full_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "The, was", "text", "doc_id")
    return out.select("doc_id", F.round("rank", 9).alias("rank"))


_FULL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS ws FROM documents
), n AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'the')) AS a, len(list_filter(ws, lambda x: x = 'was')) AS b FROM w)
SELECT doc_id, round((a / (a + 1) + b / (b + 1)) / 2, 9) AS rank FROM n WHERE a > 0 AND b > 0 ORDER BY (a / (a + 1) + b / (b + 1)) / 2 DESC, doc_id LIMIT 20
"""


def save_batch(spark, sf_dir):
    """A save for each document, of four modes and five kinds of file; files of even ids are there before. JSON of every third does not parse."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda by, *values: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    path = F.concat(F.lit("f"), "doc_id", F.lit("."), pick(F.col("doc_id"), "md", "json", "txt", "exe", "py"))
    files = docs.where("doc_id % 2 = 0").select(path.alias("path"), F.lit("old\n").alias("content"))
    text = F.when(F.col("doc_id") % 5 == 1, F.when(F.col("doc_id") % 3 == 0, '{"a": ').otherwise('{"a": 1}')).otherwise(F.col("text"))
    asked = docs.select(path.alias("path"), text.alias("content"), pick(F.floor(F.col("doc_id") / 7), "create", "overwrite", "append", "prepend").alias("mode"))
    outcome = writes.saved(files, asked)
    now = writes.after(files, outcome).select("path", F.sha2("content", 256).alias("content_sha256"))
    return outcome.select("path", "status").join(now, "path", "left")


_SAVE = """
WITH r AS (SELECT doc_id, 'f' || doc_id || '.' || ['md', 'json', 'txt', 'exe', 'py'][(doc_id % 5 + 1)::INT] AS path, doc_id % 2 = 0 AS there, ['create', 'overwrite', 'append', 'prepend'][((doc_id // 7) % 4 + 1)::INT] AS mode,
  CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN '{"a": ' ELSE '{"a": 1}' END ELSE text END AS content FROM documents
), n AS (SELECT *, CASE mode WHEN 'append' THEN CASE WHEN there THEN 'old' || chr(10) ELSE '' END || content WHEN 'prepend' THEN trim(content) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN there THEN 'old' || chr(10) ELSE '' END ELSE content END AS new FROM r
), s AS (SELECT *, CASE WHEN doc_id % 5 = 3 THEN 'unsupported' WHEN mode = 'create' AND there THEN 'exists' WHEN doc_id % 5 = 1 AND (doc_id % 3 = 0 OR mode = 'prepend' OR (mode = 'append' AND there)) THEN 'invalid' ELSE 'written' END AS status FROM n)
SELECT path, status, CASE WHEN status = 'written' THEN sha256(new) WHEN there THEN sha256('old' || chr(10)) END AS content_sha256 FROM s
"""


def ordered_edits(spark, sf_dir):
    """Ten requests for each path, in the order of the documents' ids; every third path has a file before. The outcomes, and the content after all."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda by, *values: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    number = F.floor(F.col("doc_id") / 10)
    path = F.concat(F.lit("p"), number, F.lit("."), pick(number, "md", "json", "txt", "exe"))
    files = docs.where("doc_id % 30 = 0").select(path.alias("path"), F.lit("old text\n").alias("content"))
    text = F.when(number % 4 == 1, F.concat(F.lit('{"n": '), F.col("doc_id") % 3, F.lit("}"))).otherwise(F.col("text"))
    asked = docs.select(path.alias("path"), F.col("doc_id").alias("seq"), pick(F.floor(F.col("doc_id") * 7 / 3), "append", "create", "patch", "prepend", "overwrite").alias("mode"), text.alias("content"), pick(F.col("doc_id"), "old", "e", ": 1", "xyz").alias("old"))
    outcome, now = writes.edited(files, asked)
    return outcome.join(now.select("path", F.sha2("content", 256).alias("content_sha256")), "path", "left")


_EDITS = """
WITH RECURSIVE r AS (SELECT doc_id AS seq, doc_id // 10 AS number, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS k, 'p' || (doc_id // 10) || '.' || ['md', 'json', 'txt', 'exe'][(doc_id // 10 % 4 + 1)::INT] AS path,
  ['append', 'create', 'patch', 'prepend', 'overwrite'][((doc_id * 7 // 3) % 5 + 1)::INT] AS mode, CASE WHEN doc_id // 10 % 4 = 1 THEN '{"n": ' || (doc_id % 3) || '}' ELSE text END AS content, ['old', 'e', ': 1', 'xyz'][(doc_id % 4 + 1)::INT] AS old FROM documents
), f AS (SELECT DISTINCT path, number % 3 = 0 AS there FROM r
), s AS (
  SELECT path, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS status, CASE WHEN there THEN 'old text' || chr(10) END AS now, there FROM f
  UNION ALL
  SELECT path, k, seq, status, CASE WHEN status = 'written' THEN new ELSE now END, there OR status = 'written' FROM (
    SELECT *, CASE WHEN path LIKE '%.exe' THEN 'unsupported' WHEN mode = 'create' AND there THEN 'exists' WHEN mode = 'patch' AND stands = 0 THEN 'unmatched' WHEN mode = 'patch' AND stands > 1 THEN 'ambiguous'
      WHEN content IS NULL OR (path LIKE '%.json' AND NOT json_valid(new)) THEN 'invalid' ELSE 'written' END AS status FROM (
      SELECT r.path, r.k, r.seq, r.mode, r.content, s.now, s.there, (length(coalesce(now, '')) - length(replace(coalesce(now, ''), old, ''))) // length(old) AS stands,
        CASE mode WHEN 'append' THEN coalesce(now, '') || content WHEN 'prepend' THEN trim(content, ' ') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(now, '') WHEN 'patch' THEN replace(coalesce(now, ''), old, content) ELSE content END AS new
      FROM s JOIN r ON r.path = s.path AND r.k = s.k + 1)))
SELECT path, seq, status, (SELECT CASE WHEN z.now IS NOT NULL THEN sha256(z.now) END FROM s z WHERE z.path = s.path ORDER BY z.k DESC LIMIT 1) AS content_sha256 FROM s WHERE k > 0
"""


def glob_delete(spark, sf_dir):
    """How many files each pattern of a delete names."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"))
    return writes.glob_deletes(docs, ["src1/*.e[ns]", "src*/1?.*", "none/*.md"])[1]


_GLOB = r"""
WITH p AS (SELECT source || '/' || doc_id || '.' || lang AS path FROM documents), g(pattern, re) AS (VALUES ('src1/*.e[ns]', '^src1/[^/]*\.e[ns]$'), ('src*/1?.*', '^src[^/]*/1[^/]\.[^/]*$'), ('none/*.md', '^none/[^/]*\.md$'))
SELECT pattern, count(path)::BIGINT AS files FROM g LEFT JOIN p ON regexp_matches(path, re) GROUP BY 1
"""


def job_tasks(spark, sf_dir):
    """Languages of a source as tasks: the least text of each; those without a long document were stopped."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project"), F.col("lang").alias("task")).agg(F.min("text").alias("text"), F.max(F.octet_length("text")).alias("most"))
    gated = docs.withColumn("error", F.when(F.col("most") < 10_000, "too short"))
    every, two = writes.task_output(gated, ["*"]), writes.task_output(gated, ["fr", "en"])
    told = lambda df, name: df.select("project", F.lit(name).alias("job"), F.sha2("output", 256).alias("output_sha256"), "failed")
    return told(every, "all").unionByName(told(two, "two"))


_TASKS = """
WITH g AS (SELECT source AS project, lang AS task, min(text) AS text, max(strlen(text)) < 10000 AS bad FROM documents GROUP BY 1, 2
), j AS (SELECT *, 'all' AS job, 0 AS place FROM g UNION ALL SELECT *, 'two', CASE task WHEN 'fr' THEN 1 ELSE 2 END FROM g WHERE task IN ('fr', 'en'))
SELECT project, job, sha256(coalesce(string_agg('## Task: ' || task || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place, task) FILTER (NOT bad), '')) AS output_sha256, count(*) FILTER (bad)::BIGINT AS failed FROM j GROUP BY 1, 2
"""


def context_told_once(spark, sf_dir):
    """A context per conversation whose words are paragraphs, each told once over all sections but the header."""
    turns = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "system", "header").when(F.col("role") == "user", "prompt").otherwise("memory")
    parts = turns.select("conv_id", section.alias("section"), F.col("turn").alias("ord"), F.replace("text", F.lit(" "), F.lit("\n\n")).alias("text"))
    once = assembly.told_once(parts, ["conv_id"])
    removed = once.groupBy("conv_id").agg(F.sum("paragraphs_removed").alias("paragraphs_removed"))
    return assembly.assembled(once, ["conv_id"]).join(removed, "conv_id").select("conv_id", F.sha2("context", 256).alias("context_sha256"), "paragraphs_removed")


_ONCE = r"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 3 ELSE 5 END AS s, replace(text, ' ', chr(10) || chr(10)) AS text FROM conversations
), p AS (SELECT conv_id, turn, s, unnest(string_split_regex(text, '\n[\t\n\f\r ]*\n+')) AS raw, unnest(range(len(string_split_regex(text, '\n[\t\n\f\r ]*\n+')))) AS i FROM t WHERE s > 0
), k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS par FROM p WHERE trim(raw, ' ' || chr(9) || chr(10) || chr(13)) <> ''
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, regexp_replace(par, '\s+', ' ', 'g') ORDER BY s, turn, i) AS rn FROM k
), r AS (SELECT conv_id, s, turn, string_agg(par, chr(10) || chr(10) ORDER BY i) FILTER (rn = 1) AS text, count(*) FILTER (rn > 1) AS gone FROM n GROUP BY 1, 2, 3
), u AS (SELECT * FROM r UNION ALL SELECT conv_id, s, turn, text, 0 FROM t WHERE s = 0)
SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY s, turn) FILTER (trim(text) <> '')) AS context_sha256, sum(gone)::BIGINT AS paragraphs_removed FROM u GROUP BY 1 HAVING count(*) FILTER (trim(text) <> '') > 0
"""


def context_core_once(spark, sf_dir):
    """Parts named by their turn, every fourth a core file that several sections load: which parts a context takes, and where."""
    turns = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "system", "agents").when(F.col("role") == "user", "prompt").otherwise("skills")
    parts = turns.select("conv_id", section.alias("section"), F.col("turn").cast("int").alias("ord"), (F.col("turn") % 4).cast("string").alias("name"), (F.floor(F.col("turn") / 4) % 2 == 0).alias("core"), F.coalesce("text", F.lit("")).alias("text"))
    out = assembly.core_once(parts, ["conv_id"])
    return out.select("conv_id", "section", F.col("ord").cast("long").alias("ord"), "name", "core", F.sha2("text", 256).alias("text_sha256"))


_CORE = """
WITH p AS (SELECT conv_id, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 3 ELSE 2 END AS s, CASE role WHEN 'system' THEN 'agents' WHEN 'user' THEN 'prompt' ELSE 'skills' END AS section, turn AS ord, (turn % 4)::VARCHAR AS name, (turn // 4) % 2 = 0 AS core, coalesce(text, '') AS text FROM conversations
), c AS (SELECT * FROM p WHERE core AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, name ORDER BY s, ord) = 1)
SELECT conv_id, section, -1::BIGINT AS ord, name, core, sha256(text) AS text_sha256 FROM c
UNION ALL SELECT conv_id, section, ord::BIGINT, name, core, sha256(text) FROM p WHERE NOT core AND NOT EXISTS (SELECT 1 FROM p q WHERE q.core AND q.conv_id = p.conv_id AND q.section = p.section AND q.name = p.name)
"""

QUERIES = {
    "memory_recent": (memory_recent, _RECENT),
    "memory_everything": (memory_everything, _EVERYTHING),
    "memory_insert": (memory_insert, _INSERT),
    "knowledge_table": (knowledge_table, _KNOWLEDGE),
    "project_table": (project_table, _PROJECTS),
    "full_text_search": (full_text_search, _FULL),
    "save_batch": (save_batch, _SAVE),
    "ordered_edits": (ordered_edits, _EDITS),
    "glob_delete": (glob_delete, _GLOB),
    "job_tasks": (job_tasks, _TASKS),
    "context_told_once": (context_told_once, _ONCE),
    "context_core_once": (context_core_once, _CORE),
}
