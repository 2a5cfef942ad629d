"""Queries of matching, search, focus and the memory log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import focus, fused, search
from tessera.plans import table

_FOLD = "translate(lower({c}), 'áàäâéèëêíìïîóòöôúùüûñç', 'aaaaeeeeiiiioooouuuunc')"


def like_search(spark, sf_dir):
    """Documents that hold `vieux` or `été`, blind to case and accents, and how they match as they stand."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(tx.like(F.col("text"), F.lit("Vieux")) | tx.like(F.col("text"), F.lit("été"))).select("doc_id", tx.like(F.col("text"), F.lit("Vieux")).alias("first"), tx.target_matches(F.col("text"), F.lit("=été")).alias("exact"))


_LIKE = f"SELECT doc_id, contains({_FOLD.format(c='text')}, 'vieux') AS first, contains(text, 'été') AS exact FROM documents WHERE contains({_FOLD.format(c='text')}, 'vieux') OR contains({_FOLD.format(c='text')}, 'ete')"


def all_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(tx.all_words(F.col("text"), F.lit("The ING tión"))).select("doc_id", "lang")


_WORDS = f"SELECT doc_id, lang FROM documents WHERE contains({_FOLD.format(c='text')}, 'the') AND contains({_FOLD.format(c='text')}, 'ing') AND contains({_FOLD.format(c='text')}, 'tion')"


def glob_sources(spark, sf_dir):
    """Documents whose path, source/id.lang, matches one of two globs."""
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return docs.where(tx.glob_matches(F.col("path"), "src1?/*.e[ns]") | tx.glob_matches(F.col("path"), "**/1*0.fr"))


_GLOB = r"SELECT doc_id, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE regexp_matches(source || '/' || doc_id || '.' || lang, '^src1[^/]/[^/]*\.e[ns]$') OR regexp_matches(doc_id || '.' || lang, '^1[^/]*0\.fr$')"


def keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = search.keyword_search(docs.select("doc_id", "source", "text"), "sthe", "source", "text")
    return out.select("doc_id", F.round("score", 9).alias("score"), "excerpt", "line")


_SEARCH = """
WITH d AS (SELECT doc_id, source, text, lower(text) AS low, strpos(lower(text), 'sthe') AS p FROM documents WHERE contains(lower(text), 'sthe') OR contains(lower(source), 'sthe')
), n AS (SELECT *, (length(low) - length(replace(low, 'sthe', ''))) / 4 AS c FROM d)
SELECT doc_id, round(0 + c / (c + 5) * 0.4::DOUBLE, 9) AS score, substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + 70) AS excerpt, (len(string_split(left(text, p), chr(10))))::BIGINT AS line FROM n
"""


def text_matches(spark, sf_dir):
    """Every hit of `ana` in the lines of the documents, overlapping ones too."""
    return search.matches_in_text(table(spark, sf_dir, "documents"), "ana", "doc_id").select("doc_id", "row", F.col("col").cast("long").alias("col"))


_MATCHES = """
WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents
), i AS (SELECT doc_id, row, line, unnest(range(1, length(line) - 1)) AS i FROM l WHERE contains(line, 'ana'))
SELECT doc_id, row::INT AS row, strlen(left(line, (i - 1)::BIGINT))::BIGINT AS col FROM i WHERE substr(line, i, 3) = 'ana'
"""


def memory_log(spark, sf_dir):
    """A log per event type: one dated entry per day with the day's events."""
    events = table(spark, sf_dir, "events")
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    entry = F.concat(F.lit("## "), F.date_format("day", "yyyy-MM-dd"), F.lit("\nevents: "), F.col("n").cast("string"))
    logs = days.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", entry.alias("entry")))).alias("e"))
    return logs.select("event_type", F.concat(F.lit("an undated note" + search.ENTRY_BREAK), F.array_join(F.transform("e", lambda x: x["entry"]), search.ENTRY_BREAK)).alias("text"))


_DAYS = "SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2"


def archived_logs(spark, sf_dir):
    """Entries of the logs, those older than ten days before the last event's day marked for archives by month."""
    entries = search.entries(memory_log(spark, sf_dir), "event_type")
    last = table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("last_day"))
    return search.archive_split(entries.join(F.broadcast(last), how="cross"), F.col("last_day"), 10)


def memory_archive(spark, sf_dir):
    return archived_logs(spark, sf_dir).select("event_type", F.col("entry_ord").cast("long").alias("entry_ord"), "entry", "archived", "archive_month")


_ARCHIVE = f"""
WITH d AS ({_DAYS}), m AS (SELECT max(ts)::DATE - 10 AS cut FROM events)
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS entry_ord, '## ' || strftime(day, '%Y-%m-%d') || chr(10) || 'events: ' || n AS entry, day < cut AS archived, CASE WHEN day < cut THEN strftime(day, '%Y-%m') END AS archive_month FROM d, m
UNION ALL SELECT DISTINCT event_type, 0, 'an undated note', false, NULL FROM events
"""


def memory_read_all(spark, sf_dir):
    """The logs as they are read with their archives."""
    return search.read_all(archived_logs(spark, sf_dir), "event_type").select("event_type", F.sha2("text", 256).alias("text_sha256"))


_READ_ALL = f"WITH a AS ({_ARCHIVE}) SELECT event_type, sha256(string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY archived, archive_month DESC NULLS LAST, entry_ord)) AS text_sha256 FROM a GROUP BY 1"


def like_top(spark, sf_dir):
    """The first twenty documents, by name, that hold `the` in name or text."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), "text")
    return search.like_top(docs, "The", "name", "text").select("name", "score")


_LIKE_TOP = "SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS name, 0.5::DOUBLE AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the') ORDER BY 1 LIMIT 20"


def excluded_scan(spark, sf_dir):
    """Documents in folders by id, some of which a scan leaves out: files per excluded folder."""
    folder = F.get(F.array(*[F.lit(d) for d in ("src", "vendor", "lib/build", "docs", ".git/dist")]), (F.col("doc_id") % 5).cast("int"))
    return focus.scan_stats(table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), "source", F.lit("/"), "doc_id").alias("path")))


_EXCLUDED = "SELECT [NULL, 'vendor', 'build', NULL, '.git'][(doc_id % 5 + 1)::INT] AS excluded_dir, count(*)::BIGINT AS files FROM documents GROUP BY 1"


def memory_delete_range(spark, sf_dir):
    """What a request deletes from the logs: a range of days of each, told by counts."""
    entries = search.entries(memory_log(spark, sf_dir), "event_type")
    first = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("d")).first()["d"]
    gone = search.deleted(F.col("entry_date"), F.lit(False), since=str(first), until=f"{first:%Y-%m}-12")
    return entries.groupBy("event_type").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


_DELETE = f"""
WITH d AS ({_DAYS}), m AS (SELECT min(ts)::DATE AS a, date_trunc('month', min(ts))::DATE + 11 AS b FROM events)
SELECT event_type, count(*) FILTER (day BETWEEN a AND b)::BIGINT AS deleted, (count(*) FILTER (NOT day BETWEEN a AND b) + 1)::BIGINT AS kept FROM d, m GROUP BY 1
"""


def memory_deletes(spark, sf_dir):
    """A table of delete requests for the logs, two for each: all four modes. Entries older than ten days count as archived."""
    entries = search.entries(memory_log(spark, sf_dir), "event_type")
    last = table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("last"), F.to_date(F.min("ts")).alias("first"))
    logs = entries.select("event_type").distinct()
    entries = entries.join(F.broadcast(last)).withColumn("archived", F.coalesce(F.col("entry_date") < F.date_sub("last", 10), F.lit(False))).drop("last", "first")
    asked = logs.join(F.broadcast(last))
    first = F.when(F.col("event_type") < "d", "archived").when(F.col("event_type") < "f", "range").when(F.col("event_type") < "q", "date").otherwise("all")
    one = asked.select("event_type", F.lit(1).alias("seq"), first.alias("mode"), F.date_sub("last", 5).alias("since"), F.date_sub("last", 2).alias("until"))
    two = asked.select("event_type", F.lit(2).alias("seq"), F.lit("range").alias("mode"), F.date_sub("last", 3).alias("since"), F.col("last").alias("until"))
    none = asked.select("event_type", F.lit(3).alias("seq"), F.lit("range").alias("mode"), F.col("last").alias("since"), F.lit(None).cast("date").alias("until"))
    told, left = search.deleted_by(entries, one.union(two).union(none), "event_type")
    stays = left.groupBy("event_type").agg(F.count("*").alias("kept"))
    return told.join(stays, "event_type", "left").select("event_type", "seq", "mode", "deleted", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


_DELETES = f"""
WITH d AS ({_DAYS}), b AS (SELECT max(ts)::DATE AS last FROM events
), e AS (SELECT event_type, day, day < last - 10 AS archived, last FROM d, b UNION ALL SELECT DISTINCT event_type, NULL::DATE, false, last FROM d, b
), r AS (SELECT *, CASE WHEN event_type < 'd' THEN 'archived' WHEN event_type < 'f' THEN 'range' WHEN event_type < 'q' THEN 'date' ELSE 'all' END AS mode FROM e
), h AS (SELECT *, CASE mode WHEN 'archived' THEN archived WHEN 'range' THEN NOT archived AND coalesce(day BETWEEN last - 5 AND last - 2, false) WHEN 'date' THEN NOT archived AND coalesce(day = last - 5, false) ELSE true END AS a, NOT archived AND coalesce(day BETWEEN last - 3 AND last, false) AS z FROM r
), c AS (SELECT event_type, mode, count(*) FILTER (a)::BIGINT AS one, count(*) FILTER (z AND NOT a)::BIGINT AS two, count(*) FILTER (NOT a AND NOT z)::BIGINT AS kept FROM h GROUP BY 1, 2)
SELECT event_type, seq::INT AS seq, CASE seq WHEN 1 THEN mode ELSE 'range' END AS mode, CASE seq WHEN 1 THEN one WHEN 2 THEN two ELSE 0 END::BIGINT AS deleted, kept FROM c, unnest([1, 2, 3]) u(seq)
"""


def headed(spark, sf_dir):
    """Documents as files with a heading on every third line and a date on every fifth."""
    mark = lambda s, i: F.when(i % 3 == 1, F.concat(F.lit("## "), s)).when(i % 5 == 2, F.concat(F.lit("2024-01-0"), (i % 9 + 1).cast("string"), F.lit(" "), s)).otherwise(s)
    text = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), text.alias("content"))


_HEADED = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), f AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN '## ' || line WHEN i % 5 = 2 THEN '2024-01-0' || (i % 9 + 1) || ' ' || line ELSE line END AS line FROM l)"""


def section_extract(spark, sf_dir):
    """Markdown sections whose heading holds a target."""
    targets = spark.createDataFrame([("eau",), ("=The",), ("ión",)], "target string")
    out = focus.matching_sections(headed(spark, sf_dir), targets, focus.MARKDOWN_HEADING, "doc-section")
    return out.select("target", F.col("source").alias("doc_id"), F.col("section_ord").cast("long").alias("section_ord"), F.sha2("content", 256).alias("content_sha256"))


_SECTION = f"""
WITH {_HEADED}, h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM f
), s AS (SELECT doc_id, sec, arg_min(line, i) AS heading, string_agg(line, chr(10) ORDER BY i) AS section FROM h WHERE sec > 0 GROUP BY 1, 2)
SELECT target, doc_id, (sec - 1)::BIGINT AS section_ord, sha256(section) AS content_sha256 FROM s, (VALUES ('eau'), ('=The'), ('ión')) t(target)
WHERE CASE WHEN target = '=The' THEN contains(heading, 'The') ELSE contains({_FOLD.format(c='heading')}, {_FOLD.format(c='target')}) END
"""


def dated_entries(spark, sf_dir):
    """Entries between dated lines that hold a target."""
    targets = spark.createDataFrame([("stupid",), ("été",)], "target string")
    out = focus.matching_entries(headed(spark, sf_dir), targets)
    return out.select("target", F.col("source").alias("doc_id"), F.col("section_ord").cast("long").alias("section_ord"), F.sha2("content", 256).alias("content_sha256"))


_DATED = f"""
WITH {_HEADED}, h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*\\**\\[?(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})\\]?\\**') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM f
), s AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY i) AS section FROM h WHERE sec > 0 GROUP BY 1, 2)
SELECT target, doc_id, (sec - 1)::BIGINT AS section_ord, sha256(section) AS content_sha256 FROM s, (VALUES ('stupid'), ('été')) t(target) WHERE contains({_FOLD.format(c='section')}, {_FOLD.format(c='target')})
"""


def focus_cascade(spark, sf_dir):
    """Targets resolved by path, then section, then excerpt; what nothing resolves says so."""
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    targets = spark.createDataFrame([("src1/000000001.md",), ("000000007.md",), ("worthless",), ("no such thing 42",)], "target string")
    found = focus.cascade([focus.by_path(files, targets), focus.matching_sections(files, targets, focus.MARKDOWN_HEADING, "doc-section"), focus.excerpts(files, targets)])
    return focus.rendered(targets, found).select("target", F.sha2("text", 256).alias("text_sha256"))


_CASCADE = f"""
WITH f AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, string_split(text, chr(10)) AS ls, text FROM documents
), p AS (SELECT 'src1/000000001.md' AS target, path, text AS content FROM f WHERE path = 'src1/000000001.md'
  UNION ALL SELECT '000000007.md', min(path), arg_min(text, path) FROM f WHERE ends_with(path, '/000000007.md') HAVING count(*) > 0
), l AS (SELECT path, ls, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM f
), e AS (SELECT 'worthless' AS target, path, array_to_string(ls[greatest(i - 10, 0) + 1:i + 10], chr(10)) AS content FROM l WHERE contains({_FOLD.format(c='line')}, 'worthless') ORDER BY path, i LIMIT 1
), b AS (SELECT * FROM p UNION ALL SELECT * FROM e)
SELECT t.target, sha256('FOCUS:' || t.target || chr(10) || coalesce('FILE:' || path || chr(10) || content, '  not found: ' || t.target)) AS text_sha256
FROM (VALUES ('src1/000000001.md'), ('000000007.md'), ('worthless'), ('no such thing 42')) t(target) LEFT JOIN b ON b.target = t.target
"""


def code_symbols(spark, sf_dir):
    """Documents as files with a function each: two named exactly, one in another case, one by a part of its name, one not at all."""
    docs = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("\nimport fn_"), "doc_id", F.lit(" as it\n  def fn_"), "doc_id", F.lit("(x):\n    one "), "doc_id", F.lit("\n\n    two\n  end\ntype T"), "doc_id", F.lit(" struct {\n  a { b }\n}\nrest"))
    files = docs.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".py")).alias("path"), F.concat("text", code).alias("content"))
    targets = spark.createDataFrame([("fn_7",), ("FN_12()",), ("t3",), ("n_1",), ("=n_2",)], "target string")
    return focus.code_blocks_of(files, targets).drop("kind")


_SYMBOLS = """
WITH f AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') || '.py' AS source, '  def fn_' || doc_id || '(x):' || chr(10) || '    one ' || doc_id || chr(10) || chr(10) || '    two' AS def, 'type T' || doc_id || ' struct {' || chr(10) || '  a { b }' || chr(10) || '}' AS typ FROM documents)
SELECT 'fn_7' AS target, source, def AS content FROM f WHERE doc_id = 7 UNION ALL SELECT 'FN_12()', source, def FROM f WHERE doc_id = 12 UNION ALL SELECT 't3', source, typ FROM f WHERE doc_id = 3
UNION ALL (SELECT 'n_1', source, def FROM f WHERE starts_with(doc_id::VARCHAR, '1') ORDER BY source LIMIT 1)
"""


def focus_resolvers(spark, sf_dir):
    """Documents and events as files; targets through all resolvers: a JSON node, a directory, a glob, and one that is not there."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("ev/"), "event_id", F.lit(".json")).alias("path"), F.col("props").alias("content"))
    targets = spark.createDataFrame([("ev/5.json#k",), ("src1/",), ("00000001?.md",), ("no such thing 42",)], "target string")
    found = focus.resolved(docs.union(events), targets)
    return focus.rendered_by_kind(targets, found).select("target", F.sha2("text", 256).alias("text_sha256"), "n_sources")


_RESOLVERS = """
WITH d AS (SELECT doc_id, source, lpad(doc_id::VARCHAR, 9, '0') || '.md' AS name, text FROM documents
), b AS (SELECT 'ev/5.json#k' AS target, '  (ev/5.json#k)' || chr(10) || json_extract_string(props, '$.k') AS body, 1 AS n FROM events WHERE event_id = 5
  UNION ALL SELECT 'src1/', '  src1(' || count(*) || '): ' || string_agg(name, ', ' ORDER BY name), 1 FROM d WHERE source = 'src1' HAVING count(*) > 0
  UNION ALL SELECT '00000001?.md', string_agg(text, chr(10) || chr(10) ORDER BY source || '/' || name), count(*) FROM d WHERE doc_id BETWEEN 10 AND 19 HAVING count(*) > 0)
SELECT t.target, sha256('FOCUS:' || t.target || chr(10) || coalesce(body, '  not found: ' || t.target) || chr(10)) AS text_sha256, coalesce(n, 0)::BIGINT AS n_sources
FROM (VALUES ('ev/5.json#k'), ('src1/'), ('00000001?.md'), ('no such thing 42')) t(target) LEFT JOIN b ON b.target = t.target
"""


def focus_fused(spark, sf_dir):
    """Six files a document, and targets of all ten kinds, resolved in one pass over the files."""
    docs = table(spark, sf_dir, "documents")
    i = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    files = [
        (line("src/", F.col("source"), "/", i, ".md"), line(F.coalesce("text", F.lit("")), "\n## Topic t", F.col("doc_id") % 50, "\nabout ", i, "\n")),
        (line("code/", i, ".go"), line("package p\n\nfunc Run", i, "(a int) {\n\tif a { b() }\n}\n")),
        (line("db/", i, ".sql"), line("-- tables\nCREATE TABLE users_", i, " (\n  id int\n);\nselect 1")),
        (line("law/", i, ".doc"), line("Preamble\nArtículo ", i, ". Of things\ntext of ", i, "\nArtículo none. Rest")),
        (line("log/", i, ".log"), line("2024-01-05 entry", i, " began\n more\n2024-01-06 entry", i, " ended\n2024-01-07 other")),
        (line("conf/", i, ".json"), line('{"a": {"it\'s": "v', i, '"}}')),
    ]
    each = F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in files])
    n = lambda k: f"{k:09d}"
    asked = [f"db/{n(3)}.sql", f"{n(4)}.go", "src/src1/", f"{n(5)}.json#a.it's", f"USERS_{n(6)}", f"Run{n(7)}()", "topic T7", f"articulo {n(8)}", f"Entry{n(9)}", "law/00000001?.doc", f"about {n(11)}", "began more", "no such thing 42"]
    targets = spark.createDataFrame([(t,) for t in asked], "target string")
    found = fused.fused(docs.select(F.inline(each)), targets)
    return found.select("target", "source", "kind", F.sha2("content", 256).alias("content_sha256"), "prio")


_FUSED = """
WITH d AS (SELECT doc_id, source, lpad(doc_id::VARCHAR, 9, '0') AS i, coalesce(text, '') || chr(10) || '## Topic t' || (doc_id % 50) || chr(10) || 'about ' || lpad(doc_id::VARCHAR, 9, '0') || chr(10) AS md FROM documents
), f AS (SELECT *, 'src/' || source || '/' || i || '.md' AS path, 'package p' || chr(10) || chr(10) || 'func Run' || i || '(a int) {' || chr(10) || chr(9) || 'if a { b() }' || chr(10) || '}' AS fn, '-- tables' || chr(10) || 'CREATE TABLE users_' || i || ' (' || chr(10) || '  id int' || chr(10) || ');' AS ddl FROM d
), r AS (
  SELECT 'db/000000003.sql' AS target, 'db/' || i || '.sql' AS source, 'file' AS kind, ddl || chr(10) || 'select 1' AS content, 0 AS prio FROM f WHERE doc_id = 3
  UNION ALL SELECT '000000004.go', 'code/' || i || '.go', 'file', fn || chr(10), 0 FROM f WHERE doc_id = 4
  UNION ALL SELECT 'src/src1/', 'src/src1', 'dir-index', 'src/src1(' || count(*) || '): ' || array_to_string(list_sort(list(i || '.md'))[1:1000], ', ') || CASE WHEN count(*) > 1000 THEN ', ...' ELSE '' END, 1 FROM f WHERE source = 'src1' HAVING count(*) > 0
  UNION ALL SELECT '000000005.json#a.it''s', 'conf/' || i || '.json#a.it''s', 'json-node', 'v' || i, 2 FROM f WHERE doc_id = 5
  UNION ALL SELECT 'USERS_000000006', 'db/' || i || '.sql', 'sql', 'CREATE TABLE users_' || i || ' (' || chr(10) || '  id int' || chr(10) || ');', 3 FROM f WHERE doc_id = 6
  UNION ALL SELECT 'Run000000007()', 'code/' || i || '.go', 'code-symbol', substr(fn, 12), 4 FROM f WHERE doc_id = 7
  UNION ALL SELECT 'topic T7', path, 'doc-section', '## Topic t7' || chr(10) || 'about ' || i || chr(10), 5 FROM f WHERE doc_id % 50 = 7
  UNION ALL SELECT 'articulo 000000008', 'law/' || i || '.doc', 'legal-article', 'Artículo ' || i || '. Of things' || chr(10) || 'text of ' || i, 6 FROM f WHERE doc_id = 8
  UNION ALL SELECT 'Entry000000009', 'log/' || i || '.log', 'chronological', '2024-01-05 entry' || i || ' began' || chr(10) || ' more' || chr(10) || '---' || chr(10) || '2024-01-06 entry' || i || ' ended', 7 FROM f WHERE doc_id = 9
  UNION ALL SELECT 'law/00000001?.doc', 'law/' || i || '.doc', 'file', 'Preamble' || chr(10) || 'Artículo ' || i || '. Of things' || chr(10) || 'text of ' || i || chr(10) || 'Artículo none. Rest', 8 FROM f WHERE doc_id BETWEEN 10 AND 19
  UNION ALL SELECT 'about 000000011', path, 'bounded-excerpt', array_to_string(string_split(md, chr(10))[greatest(1, len(string_split(md, chr(10))) - 11):], chr(10)), 9 FROM f WHERE doc_id = 11)
SELECT target, source, kind, sha256(content) AS content_sha256, prio::INT AS prio FROM r
"""


def legal_sections(spark, sf_dir):
    """Legal sections: every fourth line of a document is an article's heading, which names its line."""
    mark = lambda s, i: F.when(i % 4 == 1, F.concat(F.lit("Artículo "), i.cast("string"), F.lit(". "), s)).otherwise(s)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("content"))
    targets = spark.createDataFrame([("articulo 5.",), ("=Artículo 9.",)], "target string")
    out = focus.matching_sections(files, targets, focus.LEGAL_HEADING, "legal-article")
    return out.select("target", F.col("source").alias("doc_id"), F.sha2("content", 256).alias("content_sha256"))


_LEGAL = """
WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), s AS (SELECT doc_id, unnest([5, 9]) AS i, ls FROM f)
SELECT CASE i WHEN 5 THEN 'articulo 5.' ELSE '=Artículo 9.' END AS target, doc_id, sha256('Artículo ' || i || '. ' || array_to_string(ls[i + 1:i + 4], chr(10))) AS content_sha256 FROM s WHERE len(ls) > i
"""


def directory_index(spark, sf_dir):
    """The pages' addresses as a tree: what each folder holds."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return focus.directory_index(pages)


_INDEX = r"""
WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p FROM pages
), l AS (SELECT DISTINCT array_to_string(p[1:d], '/') AS dir, p[d + 1] || CASE WHEN d + 1 < len(p) THEN '/' ELSE '' END AS child FROM (SELECT p, unnest(range(1, len(p))) AS d FROM p WHERE len(p) > 1))
SELECT dir, dir || '(' || count(*) || '): ' || string_agg(child, ', ' ORDER BY child) AS listing FROM l GROUP BY dir
"""


def json_node(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", focus.json_node(F.col("props"), "k").alias("node"))


QUERIES = {
    "like_search": (like_search, _LIKE),
    "all_words": (all_words, _WORDS),
    "glob_sources": (glob_sources, _GLOB),
    "keyword_search": (keyword_search, _SEARCH),
    "text_matches": (text_matches, _MATCHES),
    "memory_archive": (memory_archive, _ARCHIVE),
    "memory_read_all": (memory_read_all, _READ_ALL),
    "like_top": (like_top, _LIKE_TOP),
    "excluded_scan": (excluded_scan, _EXCLUDED),
    "memory_delete_range": (memory_delete_range, _DELETE),
    "memory_deletes": (memory_deletes, _DELETES),
    "section_extract": (section_extract, _SECTION),
    "dated_entries": (dated_entries, _DATED),
    "focus_cascade": (focus_cascade, _CASCADE),
    "code_symbols": (code_symbols, _SYMBOLS),
    "focus_resolvers": (focus_resolvers, _RESOLVERS),
    "focus_fused": (focus_fused, _FUSED),
    "legal_sections": (legal_sections, _LEGAL),
    "directory_index": (directory_index, _INDEX),
    "json_node": (json_node, "SELECT event_id, json_extract_string(props, '$.k') AS node FROM events"),
}
