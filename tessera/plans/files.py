"""Queries of file sources and sinks over tables written as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import layout
from tessera.operators import assembly, gate, groups
from tessera.plans import table
from tessera.sources import files, sheets


def patch_unique(spark, sf_dir):
    """`with` made `without` in the documents that hold it exactly once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", files.occurrences(F.col("text"), F.lit("with")).cast("long").alias("n"), F.sha2(files.patched(F.col("text"), F.lit("with"), F.lit("without")), 256).alias("text_sha256"))


_PATCH = "SELECT doc_id, ((length(text) - length(replace(text, 'with', ''))) // 4)::BIGINT AS n, CASE WHEN (length(text) - length(replace(text, 'with', ''))) // 4 = 1 THEN sha256(replace(text, 'with', 'without')) END AS text_sha256 FROM documents"


def sheet_cells(spark, sf_dir):
    """Parts as a sheet per brand: how many cells of each column are numbers."""
    part = table(spark, sf_dir, "part")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), "p_type")
    sheets = part.select("p_brand", line.alias("text"))  # a line is a row of its own: a brand may have any number of parts
    return files.typed_cells(sheets, "p_brand", "text").groupBy("p_brand", "col", "type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "number", F.col("value").cast("double"))).cast("long").alias("total")).withColumn("col", F.col("col").cast("long"))


_SHEET = """
WITH c AS (SELECT p_brand, unnest(string_split(concat_ws(',', p_partkey, p_name, p_size, p_type), ',')) AS value, unnest(range(len(string_split(concat_ws(',', p_partkey, p_name, p_size, p_type), ',')))) AS col FROM part
), t AS (SELECT *, CASE WHEN try_cast(trim(value) AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS type FROM c)
SELECT p_brand, col, type, count(*)::BIGINT AS n, sum(CASE WHEN type = 'number' THEN value::DOUBLE END)::BIGINT AS total FROM t GROUP BY 1, 2, 3
"""


def quoted_sheets(spark, sf_dir):
    """A sheet for each part: with commas or tabs and quoted cells of two lines, or as JSON; every seventh has a stray quote."""
    part = table(spark, sf_dir, "part")
    key, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")
    row = lambda d: F.concat(key, F.lit(d), F.lit('"'), name, F.lit(', ""big""\n2nd line"'), F.lit(d), size, F.lit(f"{d}\r\n\r\n1e3{d}x{d}{d}z\n"))
    cell = lambda kind, value: F.concat(F.lit(f'{{"type":"{kind}","value":"'), value, F.lit('"}'))
    json = F.concat(F.lit('{"Parts":[['), cell("number", key), F.lit(","), cell("string", name), F.lit("]]}"))
    text = F.when(F.col("p_partkey") % 7 == 0, F.concat(key, F.lit(',a"b'))).when(F.col("p_partkey") % 3 == 0, row(",")).when(F.col("p_partkey") % 3 == 1, row("\t")).otherwise(json)
    cells, errors = sheets.parsed_sheets(part.select("p_partkey", text.alias("text")), "p_partkey")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("row", "int"), ("col", "int"), ("type", "string"))]
    return cells.unionByName(errors.select("p_partkey", *none, F.col("error").alias("value")))


_QUOTED = """
WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k, p_name, p_size::VARCHAR AS s, p_partkey % 7 = 0 AS bad, p_partkey % 3 AS m FROM part
), c AS (SELECT p_partkey, unnest([(0, 0, 'number', k), (0, 1, 'string', p_name || ', "big"' || chr(10) || '2nd line'), (0, 2, 'number', s), (0, 3, 'string', ''), (1, 0, 'number', '1e3'), (1, 1, 'string', 'x'), (1, 2, 'string', ''), (1, 3, 'string', 'z')]) AS t FROM p WHERE NOT bad AND m < 2
  UNION ALL SELECT p_partkey, unnest([(0, 0, 'number', k), (0, 1, 'string', p_name)]) FROM p WHERE NOT bad AND m = 2)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'Parts' ELSE 'Sheet1' END AS sheet, t[1]::INT AS row, t[2]::INT AS col, t[3] AS type, t[4] AS value FROM c
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'quotes' FROM p WHERE bad
"""


def page_layout(spark, sf_dir):
    """Documents on pages: each line of a text is a block, broken at 80 code points; lines, pages, digest of all lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda b: layout.wrapped(b)).alias("blocks"))
    sized = docs.withColumn("page_of", layout.pages_of(F.transform("blocks", lambda b: F.size(b))))
    return sized.select("doc_id", F.size(F.flatten("blocks")).cast("long").alias("lines"), F.array_max("page_of").cast("long").alias("pages"), F.sha2(F.array_join(F.flatten("blocks"), "\n"), 256).alias("lines_sha256"))


def context_assembly(spark, sf_dir):
    """A context per conversation: system turns as header, the rest as memory, with variables filled in."""
    turns = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "system", "header").when(F.col("role") == "user", "prompt").otherwise("memory")
    text = F.concat(F.lit("{{WHO}} {{NO}}: "), "text")
    project = F.create_map(F.lit("who"), F.lit("someone"))
    task = F.create_map(F.lit("who"), F.col("role"))
    filled = assembly.injected(text, assembly.merged_variables(project, F.when(F.col("turn") % 2 == 0, task)))
    parts = turns.select("conv_id", section.alias("section"), F.col("turn").alias("ord"), filled.alias("text"))
    out = assembly.assembled(parts, ["conv_id"])
    return out.select("conv_id", F.sha2("context", 256).alias("context_sha256"), F.array_join(assembly.undeclared(F.col("context")), ",").alias("undeclared"))


_CONTEXT = """
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 3 ELSE 5 END AS s, CASE WHEN turn % 2 = 0 THEN role ELSE 'someone' END || ' {{NO}}: ' || text AS text FROM conversations)
SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY s, turn)) AS context_sha256, 'NO' AS undeclared FROM t GROUP BY 1
"""


def knowledge_lookup(spark, sf_dir):
    """Documents as knowledge (domain by source, language as it is): the best one for every name in German, else in the default language."""
    docs = table(spark, sf_dir, "documents").select(F.lit("skill").alias("kind"), F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.when(F.col("source") == "src1", "base").otherwise(F.col("source")).alias("domain"), "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    wanted = docs.select("kind", F.lit("src2").alias("domain"), F.lit("de").alias("lang"), "name").distinct()
    return assembly.knowledge(docs, wanted).select("name", "path")


_KNOWLEDGE = """
WITH f AS (SELECT 'n' || doc_id % 50 AS name, CASE source WHEN 'src2' THEN 0 WHEN 'src1' THEN 2 ELSE 4 END + CASE WHEN lang = 'de' THEN 0 ELSE 1 END AS r, lpad(doc_id::VARCHAR, 9, '0') AS path, doc_id FROM documents WHERE trim(text) <> '')
SELECT name, path FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY r, path) = 1
"""



def knowledge_places(spark, sf_dir):
    """Documents as knowledge files in ten kinds of folders, some without text, looked up for a domain in German, one in English, and the defaults."""
    docs = table(spark, sf_dir, "documents")
    folders = ["skills/{d}/i18n/{l}", "skills/{d}/i18n/en", "skills/{d}/{l}", "skills/{d}/en", "skills/{d}", "skills", "skills/{d}/i18n/{l}/sub/a-b", "skills/{d}/i18n/en/sub", "skills/{d}/x", "skills/custom"]
    domain = F.when(F.col("source") == "src1", "base").when(F.col("source") < "src15", "src2").otherwise(F.col("source"))
    folder = F.get(F.array(*[F.replace(F.replace(F.lit(f), F.lit("{d}"), domain), F.lit("{l}"), F.col("lang")) for f in folders]), (F.col("doc_id") % 10).cast("int"))
    name = F.concat(F.lit("n"), (F.floor(F.col("doc_id") / 10) * 7 % 60).cast("string"))
    text = F.when(F.col("doc_id") % 6 == 0, " \n").otherwise(F.col("text"))
    held = docs.select(F.concat(folder, F.lit("/"), name, F.lit(".md")).alias("path"), text.alias("content"), "doc_id")
    held = held.groupBy("path").agg(F.min_by("content", "doc_id").alias("content"))  # a path is one file
    names = docs.select(name.alias("name")).distinct()
    asked = [names.select(F.lit("skill").alias("kind"), F.lit(d).cast("string").alias("domain"), F.lit(g).cast("string").alias("lang"), "name") for d, g in (("src2", "de"), ("src2", "en"), (None, ""))]
    out = assembly.knowledge_files(held, asked[0].union(asked[1]).union(asked[2]))
    return out.select("kind", "domain", "lang", "name", "place", "path", F.sha2("content", 256).alias("content_sha256"))


_PLACES = """
WITH d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'base' WHEN source < 'src15' THEN 'src2' ELSE source END AS d, lang AS l, 'n' || (doc_id // 10 * 7 % 60) AS name, CASE WHEN doc_id % 6 = 0 THEN ' ' || chr(10) ELSE text END AS content FROM documents
), f AS (SELECT doc_id, name, content, ['skills/' || d || '/i18n/' || l, 'skills/' || d || '/i18n/en', 'skills/' || d || '/' || l, 'skills/' || d || '/en', 'skills/' || d, 'skills', 'skills/' || d || '/i18n/' || l || '/sub/a-b', 'skills/' || d || '/i18n/en/sub', 'skills/' || d || '/x', 'skills/custom'][(doc_id % 10 + 1)::INT] || '/' || name || '.md' AS path FROM d
), h AS (SELECT path, name, arg_min(content, doc_id) AS content FROM f GROUP BY 1, 2
), w AS (SELECT * FROM (SELECT DISTINCT name FROM f), (VALUES ('src2', 'de'), ('src2', 'en'), (NULL, '')) v(domain, lang)
), a AS (SELECT *, coalesce(domain, 'base') AS d, CASE lang WHEN '' THEN 'es' ELSE lang END AS l FROM w
), m AS (SELECT a.name, domain, lang, path, content, unnest(list_filter([
    CASE WHEN path = 'skills/' || d || '/i18n/' || l || '/' || a.name || '.md' THEN 1 END, CASE WHEN path = 'skills/' || d || '/i18n/en/' || a.name || '.md' THEN 2 END, CASE WHEN path = 'skills/' || d || '/' || l || '/' || a.name || '.md' THEN 3 END,
    CASE WHEN path = 'skills/' || d || '/en/' || a.name || '.md' THEN 4 END, CASE WHEN path = 'skills/' || d || '/' || a.name || '.md' THEN 5 END, CASE WHEN path = 'skills/' || a.name || '.md' THEN 6 END,
    CASE WHEN starts_with(path, 'skills/' || d || '/i18n/' || l || '/') THEN 7 END, CASE WHEN starts_with(path, 'skills/' || d || '/i18n/en/') THEN 8 END, CASE WHEN starts_with(path, 'skills/' || d || '/') THEN 9 END, 10], lambda x: x IS NOT NULL)) AS place FROM a JOIN h ON h.name = a.name
), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name, domain, lang, place ORDER BY string_split(path, '/')) = 1)
SELECT 'skill' AS kind, domain, lang, name, place::INT AS place, path, sha256(content) AS content_sha256 FROM b WHERE trim(content, ' ' || chr(10)) <> '' QUALIFY row_number() OVER (PARTITION BY name, domain, lang ORDER BY place) = 1
"""


def group_run(spark, sf_dir):
    """Sources as groups of agents, some listed with one that is not there, others found by their project files; contexts through the gates, with a workflow."""
    docs = table(spark, sf_dir, "documents")
    own = docs.groupBy(F.col("source").alias("group"), F.col("lang").alias("agent")).agg(F.min("text").alias("head"))
    listed = F.when(F.substr("group", F.lit(4)).cast("int") % 2 == 0, F.array(F.lit("fr"), F.lit("xx"), F.lit("en")))
    configs = own.select("group").distinct().select("group", listed.alias("agents")).union(spark.range(1).select(F.lit("nobody").alias("group"), F.array().cast("array<string>").alias("agents")))
    tree = own.select(F.concat(F.lit("projects/"), "group", F.lit("/"), "agent", F.lit("/project.json")).alias("path")).union(own.select(F.concat(F.lit("projects/"), "group", F.lit("/notes.md"))))
    none = {c: F.lit(None).cast("string") for c in ("focus", "memory", "tail")}
    limits = {"token_limit": F.lit(40), "run_limit": F.lit(0), "month_usd": F.lit(0.0), "month_limit": F.lit(0.0), "on_exceed": F.lit("warn"), "enabled": F.lit(True)}
    gated = gate.gated(own.withColumns(none | limits))
    flow = groups.workflow_gate(gated.withColumn("workflow", F.when(F.col("agent") != "de", "step one\nstep two")))
    ran = groups.run_group(groups.planned(configs, tree), gated)
    flow = flow.select("group", "agent", "workflow_tokens", F.col("workflow_error").isNotNull().alias("workflow_stopped"))
    return ran.join(flow, ["group", "agent"], "left").select(F.col("group").alias("project_group"), "place", "agent", "status", "tokens", F.sha2("text", 256).alias("text_sha256"), "workflow_tokens", "workflow_stopped")


_GROUP = """
WITH o AS (SELECT source AS "group", lang AS agent, min(text) AS head FROM documents GROUP BY 1, 2
), g AS (SELECT "group", CASE WHEN substr("group", 4)::INT % 2 = 0 THEN ['fr', 'xx', 'en'] ELSE list_sort(list(agent)) END AS agents FROM o GROUP BY 1
), p AS (SELECT "group", unnest(agents) AS agent, unnest(range(len(agents))) AS place FROM g UNION ALL SELECT 'nobody', NULL, 0
), c AS (SELECT *, octet_length(encode(coalesce(head, ''))) // 4 AS tokens FROM o)
SELECT p."group" AS project_group, p.place::INT AS place, p.agent, CASE WHEN p.agent IS NULL THEN 'empty' WHEN c.agent IS NULL THEN 'missing' WHEN tokens > 40 THEN 'stopped' ELSE 'ok' END AS status, tokens::BIGINT AS tokens, CASE WHEN tokens <= 40 THEN sha256(coalesce(head, '')) END AS text_sha256,
  CASE WHEN p.agent <> 'de' AND c.agent IS NOT NULL THEN (octet_length(encode(CASE WHEN tokens <= 40 THEN coalesce(head, '') ELSE '' END || chr(10) || 'step one' || chr(10) || 'step two')) // 4)::BIGINT END AS workflow_tokens,
  CASE WHEN c.agent IS NOT NULL THEN p.agent = 'de' OR octet_length(encode(CASE WHEN tokens <= 40 THEN coalesce(head, '') ELSE '' END || chr(10) || 'step one' || chr(10) || 'step two')) // 4 > 40 END AS workflow_stopped
FROM p LEFT JOIN c ON c."group" = p."group" AND c.agent = p.agent
"""


QUERIES = {
    "patch_unique": (patch_unique, _PATCH),
    "sheet_cells": (sheet_cells, _SHEET),
    "quoted_sheets": (quoted_sheets, _QUOTED),
    "page_layout": (page_layout, None),
    "context_assembly": (context_assembly, _CONTEXT),
    "knowledge_places": (knowledge_places, _PLACES),
    "group_run": (group_run, _GROUP),
    "knowledge_lookup": (knowledge_lookup, _KNOWLEDGE),
}
