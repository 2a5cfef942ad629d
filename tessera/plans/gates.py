"""Queries of the gated context, its report, and the memo."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budget, gate, sanitize
from tessera.plans import table
from tessera.plans.texts import _PII, _RUNS


def contexts(spark, sf_dir):
    """A context per document: its text twice as two files of the focus, and a note as memory; limits by id."""
    memory = F.concat(F.lit("## note "), "lang", F.lit("\nseen\nseen\nseen\n\n\n\n\nend of "), "lang")
    focus = F.concat(F.lit("FOCUS:a.md\n"), "text", F.lit("\nFOCUS:b.md\n"), "text")
    docs = table(spark, sf_dir, "documents")
    limits = {"token_limit": F.lit(900), "run_limit": F.lit(800), "month_usd": F.col("doc_id") % 7 * 100.0, "month_limit": F.lit(500.0), "on_exceed": F.when(F.col("doc_id") % 2 == 0, "abort"), "enabled": F.when(F.col("doc_id") % 5 == 0, False)}
    return docs.select("doc_id", "source", F.concat(F.lit("# "), "source", F.lit("\n")).alias("head"), focus.alias("focus"), memory.alias("memory"), F.lit("\nAnswer.").alias("tail")).withColumns(limits)


_CONTEXTS = r"""
c0 AS (SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS ls FROM documents
), c1 AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i], ' ' || chr(9) || chr(13)) <> '')[3] AS cut FROM c0
), c2 AS (SELECT *, 'FOCUS:a.md' || chr(10) || text || chr(10) || 'FOCUS:b.md' || chr(10) AS front, '## note ' || lang || chr(10) || 'seen' || chr(10) || 'seen' || chr(10) || 'seen' || repeat(chr(10), 5) || 'end of ' || lang AS memory FROM c1
), c AS (SELECT *, front || text AS raw, front || CASE WHEN cut IS NOT NULL THEN '  [encabezado idéntico al de a.md — omitido]' || chr(10) || array_to_string(ls[cut + 1:], chr(10)) ELSE text END AS focus FROM c2
), runs AS (""" + _RUNS.replace("sha256(string_agg(CASE", "(string_agg(CASE").format(key="k", text="t", source="SELECT doc_id * 2 AS k, focus AS t FROM c UNION ALL SELECT doc_id * 2 + 1, memory FROM c") + r"""
), s AS (SELECT c.doc_id, source, '# ' || source || chr(10) AS head, a.lines_collapsed + b.lines_collapsed + (cut IS NOT NULL)::INT AS lines_removed, raw, c.memory AS raw_memory, c.focus AS deduped,
  len(regexp_extract_all(a.text_sha256, '\n{4,}')) + len(regexp_extract_all(b.text_sha256, '\n{4,}')) AS blank_removed,
  regexp_replace(a.text_sha256, '\n{4,}', repeat(chr(10), 3), 'g') AS focus, regexp_replace(b.text_sha256, '\n{4,}', repeat(chr(10), 3), 'g') AS memory
  FROM c JOIN runs a ON a.k = doc_id * 2 JOIN runs b ON b.k = doc_id * 2 + 1
), u AS (SELECT *, strlen(deduped) + strlen(raw_memory) - strlen(focus) - strlen(memory) AS chars_removed, head || focus || memory || chr(10) || 'Answer.' AS text, strlen(head || raw || raw_memory || chr(10) || 'Answer.') // 4 AS raw_tokens FROM s
), v AS (SELECT *, strlen(text) // 4 AS tokens, doc_id % 5 <> 0 AND strlen(text) // 4 > 800 AS run_over, doc_id % 5 <> 0 AND doc_id % 7 * 100 >= 500 AS month_over FROM u
), w AS (SELECT *, CASE WHEN run_over AND month_over THEN 'Circuit breaker: this run uses ' || tokens || ' tokens (per-run limit: 800) and monthly spend is already $' || doc_id % 7 * 100 || '.00 (limit: $500.00).'
  WHEN run_over THEN 'Circuit breaker: this run uses ' || tokens || ' tokens, exceeding the configured per-run limit (800).'
  WHEN month_over THEN 'Circuit breaker: monthly spend for this project is already $' || doc_id % 7 * 100 || '.00, reaching or exceeding the configured limit ($500.00).' END AS message FROM v
), g AS (SELECT *, (run_over OR month_over) AND doc_id % 2 = 0 AS aborted, CASE WHEN (run_over OR month_over) AND doc_id % 2 = 0 THEN message
  WHEN tokens > 900 THEN 'ERROR' || chr(10) || chr(10) || 'Current context (' || format('{:,}', tokens::BIGINT) || ' tokens) exceeds the configured limit (900).' || chr(10) || chr(10) || 'Suggestion:' || chr(10) || 'Use --focus to reduce the included files.' END AS error FROM w)
"""


def gated_pipeline(spark, sf_dir):
    """All contexts through sanitizer, count, breaker and limit."""
    out = gate.gated(contexts(spark, sf_dir))
    return out.select("doc_id", "lines_removed", "blank_removed", "chars_removed", "raw_tokens", "tokens", "aborted", "error", F.sha2("text", 256).alias("text_sha256"))


_GATED = "WITH " + _CONTEXTS + "SELECT doc_id, lines_removed::BIGINT AS lines_removed, blank_removed::BIGINT AS blank_removed, chars_removed::BIGINT AS chars_removed, raw_tokens::BIGINT AS raw_tokens, tokens::BIGINT AS tokens, aborted, error, CASE WHEN error IS NULL THEN sha256(text) END AS text_sha256 FROM g"


def budget_report(spark, sf_dir):
    """The report of every context; dollars with eight decimals, which the prices never exceed."""
    out = gate.report(gate.gated(contexts(spark, sf_dir)), "doc_id", budget.PRICES, digits=8)
    return out.select("doc_id", F.sha2("report", 256).alias("report_sha256"), F.octet_length("report").cast("long").alias("n_bytes"))


def _usd(n, price):
    return f"printf('%.8f', {n} * {price}::DOUBLE / 1000)"


def _table_row(name, n, strong=""):
    cells = "".join(f" || ' {strong}$' || {_usd(n, p[2])} || '{strong} |'" for p in sorted(budget.PRICES))
    return f"'| {name} | {strong}' || {n} || '{strong} |'{cells} || chr(10)"


_HEAD_ROW = "| Component | Tokens |" + "".join(f" {p[0]} {p[1]} (USD) |" for p in sorted(budget.PRICES))
_REPORT = (
    "WITH " + _CONTEXTS + ", t AS (SELECT *, strlen(head) // 4 AS t1, strlen(focus) // 4 AS t2, strlen(memory) // 4 AS t3, strlen(chr(10) || 'Answer.') // 4 AS t4, strpos(focus, chr(10) || 'FOCUS:b.md' || chr(10)) AS cut2, "
    "len('FOCUS:a.md' || chr(10)) AS skip FROM g), r AS (SELECT doc_id, '# Budget Report' || chr(10) || chr(10) || '## Project' || chr(10) || chr(10) || 'Project name: ' || doc_id || chr(10) || chr(10) || '**Final tokens sent to the model: ' || tokens || '**' || chr(10) || chr(10)"
    " || CASE WHEN lines_removed + blank_removed > 0 THEN '## Sanitizer' || chr(10) || chr(10) || 'Lines removed: ' || lines_removed || chr(10) || 'Blank runs removed: ' || blank_removed || chr(10) || 'Comment lines removed: 0' || chr(10) || 'Bytes removed: ' || chars_removed || chr(10) || chr(10) ELSE '' END"
    f" || '## Token & Cost Breakdown' || chr(10) || chr(10) || '{_HEAD_ROW}' || chr(10) || '|---|---|' || repeat('---|', {len(budget.PRICES)}) || chr(10)"
    f" || {_table_row('head', 't1')} || {_table_row('focus', 't2')} || {_table_row('memory', 't3')} || {_table_row('tail', 't4')} || {_table_row('**TOTAL**', '(t1 + t2 + t3 + t4)', '**')} || chr(10)"
    " || '## Files' || chr(10) || chr(10) || '| File | Tokens |' || chr(10) || '|---|---|' || chr(10) || '| a.md | ' || strlen(substr(focus, skip + 1, cut2 - skip - 1)) // 4 || ' |' || chr(10) || '| b.md | ' || strlen(substr(focus, cut2 + 1 + skip)) // 4 || ' |' || chr(10) || chr(10)"
    " || CASE WHEN raw_tokens > tokens THEN '## Before and After' || chr(10) || chr(10) || 'Tokens before: ' || raw_tokens || chr(10) || 'Tokens after: ' || tokens || chr(10) || chr(10) ELSE '' END"
    " || CASE WHEN message IS NOT NULL THEN '## Circuit Breaker' || chr(10) || chr(10) || message || chr(10) || chr(10) ELSE '' END"
    " || '## Budget Limit' || chr(10) || chr(10) || 'Limit: 900' || chr(10) || 'Exceeded: ' || CASE WHEN tokens > 900 THEN 'true' ELSE 'false' END || chr(10) || chr(10) AS report FROM t)"
    " SELECT doc_id, sha256(report) AS report_sha256, strlen(report)::BIGINT AS n_bytes FROM r"
)


def file_tokens(spark, sf_dir):
    """Tokens of each file of the sanitized focus."""
    return gate.file_tokens(gate.sanitize_sections(contexts(spark, sf_dir)), ["doc_id"]).select("doc_id", "name", "tokens")


_FILES = "WITH " + _CONTEXTS + """, t AS (SELECT doc_id, focus, strpos(focus, chr(10) || 'FOCUS:b.md' || chr(10)) AS cut2 FROM g)
SELECT doc_id, 'a.md' AS name, (strlen(substr(focus, 12, cut2 - 12)) // 4)::BIGINT AS tokens FROM t UNION ALL SELECT doc_id, 'b.md', (strlen(substr(focus, cut2 + 12)) // 4)::BIGINT FROM t"""


def section_masking(spark, sf_dir):
    """Focus and memory of every document with PII-shaped tokens masked: the texts themselves, by their hashes."""
    docs = table(spark, sf_dir, "documents")
    owner = F.concat(F.lit("owner user"), "doc_id", F.lit("@mail"), F.col("doc_id") * 7, F.lit(".com \n call  +56-9-"), F.col("doc_id") + 1000, F.lit("-4321 now"))
    out = gate.mask_sections(docs.select("doc_id", F.col("text").alias("focus"), owner.alias("memory")))
    return out.select("doc_id", "n_scanned", "n_masked", F.sha2("focus", 256).alias("focus_sha256"), F.sha2("memory", 256).alias("memory_sha256"))


_SECTIONS = "WITH two AS (SELECT doc_id, 'f' AS part, text FROM documents UNION ALL SELECT doc_id, 'm', 'owner user' || doc_id || '@mail' || doc_id * 7 || '.com ' || chr(10) || ' call  +56-9-' || doc_id + 1000 || '-4321 now' FROM documents), " + _PII.format(source="").replace("FROM documents", "FROM (SELECT '' AS source, text FROM two)").strip().removeprefix("WITH ") + r"""
, v AS (SELECT token, core, lower(core) AS low FROM m WHERE masked
), x AS (SELECT token, core, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen(low)), lambda i: ('0x' || substr(hex(low), (2 * i + 1)::BIGINT, 2))::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM v
), y AS (SELECT token, left(token, strpos(token, core) - 1) || '[PII_' || left(lpad(lower(printf('%x', h::UBIGINT)), 16, '0'), 8) || ']' || substr(token, strpos(token, core) + length(core)) AS tag FROM x
), p AS (SELECT doc_id, part, text, regexp_extract_all(text, '[\s\x0B\x{85}\p{Z}]*[^\s\x0B\x{85}\p{Z}]+') AS ps FROM two
), q AS (SELECT doc_id, part, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM p
), w AS (SELECT doc_id, part, i, piece, regexp_replace(piece, '^[\s\x0B\x{85}\p{Z}]+', '') AS token FROM q
), z AS (SELECT w.doc_id, part, count(*) AS n, count(y.tag) AS k, string_agg(CASE WHEN y.tag IS NULL THEN piece ELSE left(piece, length(piece) - length(w.token)) || y.tag END, '' ORDER BY i) AS body FROM w LEFT JOIN y ON y.token = w.token GROUP BY 1, 2
), o AS (SELECT p.doc_id, p.part, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(body, '') || regexp_extract(text, '[\s\x0B\x{85}\p{Z}]*$') AS body FROM p LEFT JOIN z ON z.doc_id = p.doc_id AND z.part = p.part)
SELECT doc_id, sum(n)::BIGINT AS n_scanned, sum(k)::BIGINT AS n_masked, sha256(max(body) FILTER (part = 'f')) AS focus_sha256, sha256(max(body) FILTER (part = 'm')) AS memory_sha256 FROM o GROUP BY doc_id
"""


def content_memo(spark, sf_dir):
    """Sanitized texts through the memo; the cache holds those of English documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    work = lambda df: sanitize.sanitize(df).withColumnRenamed("text", "output")
    nothing = spark.createDataFrame([], "content_key string, output string")
    _, cache = gate.memoized(docs.where("lang = 'en'"), nothing, work, "v1")
    out, _ = gate.memoized(docs, cache, work, "v1")
    return out.select("doc_id", "content_key", "hit", F.sha2("output", 256).alias("output_sha256"))


_MEMO = "WITH r AS (" + _RUNS.replace("sha256(string_agg(CASE", "(string_agg(CASE").format(key="doc_id", text="text", source="SELECT doc_id, text FROM documents") + r""")
SELECT d.doc_id, sha256('v1' || chr(0) || text) AS content_key, text IN (SELECT text FROM documents WHERE lang = 'en') AS hit, sha256(regexp_replace(text_sha256, '\n{4,}', repeat(chr(10), 3), 'g')) AS output_sha256 FROM documents d JOIN r USING (doc_id)
"""


def group_costs(spark, sf_dir):
    """The contexts' tokens by source and price; refused contexts cost nothing."""
    out = gate.cost_by_provider(gate.gated(contexts(spark, sf_dir)), budget.PRICES, "source")
    return out.withColumn("usd", F.round("usd", 9))


_GROUPS = "WITH " + _CONTEXTS + ", a AS (SELECT source, coalesce(sum(CASE WHEN error IS NULL THEN tokens ELSE 0 END), 0)::BIGINT AS tokens, count(error)::BIGINT AS failed FROM g GROUP BY 1) SELECT a.*, provider, model, round(tokens / 1000.0::DOUBLE * price, 9) AS usd FROM a, (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}::DOUBLE)" for p in budget.PRICES) + ") t(provider, model, price)"


def cheapest_provider(spark, sf_dir):
    """Per source the cheapest price that is not free, of the shipped prices and a free one."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(budget.approx_tokens(F.col("text"))).alias("tokens"))
    out = gate.cheapest(budget.costs(counts, [*budget.PRICES, ("local", "none", 0.0, 0.0)]), ["source"])
    return out.withColumn("usd", F.round("usd", 9))


_CHEAPEST = "SELECT source, 'google' AS provider, 'gemini' AS model, round(sum(strlen(text) // 4)::BIGINT / 1000.0::DOUBLE * 0.00125::DOUBLE, 9) AS usd FROM documents GROUP BY source HAVING sum(strlen(text) // 4) > 0"

QUERIES = {
    "gated_pipeline": (gated_pipeline, _GATED),
    "budget_report": (budget_report, _REPORT),
    "file_tokens": (file_tokens, _FILES),
    "section_masking": (section_masking, _SECTIONS),
    "content_memo": (content_memo, _MEMO),
    "group_costs": (group_costs, _GROUPS),
    "cheapest_provider": (cheapest_provider, _CHEAPEST),
}
