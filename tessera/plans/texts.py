"""Queries of the sanitizer and of PII masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pii, sanitize
from tessera.plans import table

_RUNS = r"""
WITH l AS (
  SELECT {key} AS k, unnest(string_split({text}, chr(10))) AS line, unnest(range(len(string_split({text}, chr(10))))) AS pos FROM ({source})
), y AS (SELECT *, regexp_replace(line, '^\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?Z?[\t\n\f\r ]*', '') AS key FROM l
), c AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY k ORDER BY pos) IS NOT DISTINCT FROM key AND pos > 0 THEN 0 ELSE 1 END AS new FROM y
), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c
), g AS (SELECT k, run, count(*) AS n, min(pos) AS pos, arg_min(line, pos) AS first, any_value(key) AS key, string_agg(line, chr(10) ORDER BY pos) AS whole FROM r GROUP BY k, run
), o AS (SELECT *, n >= 3 AND trim(key, ' ' || chr(9) || chr(13)) <> '' AS hit FROM g)
SELECT k AS {key}, coalesce(sum(CASE WHEN hit THEN n - 1 END), 0)::BIGINT AS lines_collapsed,
  sha256(string_agg(CASE WHEN hit THEN first || chr(10) || '  [×' || n || ' repeticiones idénticas omitidas]' ELSE whole END, chr(10) ORDER BY pos)) AS text_sha256
FROM o GROUP BY k
"""


def run_collapse_documents(spark, sf_dir):
    docs = sanitize.collapse_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines_collapsed", F.sha2("text", 256).alias("text_sha256"))


def event_log(spark, sf_dir):
    """A log per user: time stamp, level and type of its events, in order."""
    events = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type")
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("rows"))
    return rows.select("user_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def run_collapse_event_log(spark, sf_dir):
    return sanitize.collapse_repeats(event_log(spark, sf_dir)).select("user_id", "lines_collapsed", F.sha2("text", 256).alias("text_sha256"))


_EVENT_LOG = "SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id"


def blank_run_collapse(spark, sf_dir):
    """Lines joined by one to six newlines, by their place."""
    docs = table(spark, sf_dir, "documents")
    spread = F.array_join(F.transform(F.split("text", "\n", -1), lambda s, i: F.concat(s, F.repeat(F.lit("\n"), (1 + i % 6).cast("int")))), "")
    out = sanitize.collapse_blanks(docs.select("doc_id", spread.alias("text")))
    return out.select("doc_id", "blank_runs", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


_BLANK = r"""
WITH s AS (
  SELECT doc_id, (SELECT string_agg(x || repeat(chr(10), (1 + (i - 1) % 6)::INT), '' ORDER BY i) FROM (SELECT unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)) AS text FROM documents
)
SELECT doc_id, len(regexp_extract_all(text, '\n{4,}'))::BIGINT AS blank_runs, strlen(regexp_replace(text, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'))::BIGINT AS n_bytes,
  sha256(regexp_replace(text, '\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS text_sha256 FROM s
"""


def comment_block_strip(spark, sf_dir):
    """Every other seven lines of a document as comments."""
    docs = table(spark, sf_dir, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda s, i: F.when(F.floor(i / 7) % 2 == 0, F.concat(F.lit("// "), s)).otherwise(s)), "\n")
    out = sanitize.strip_comments(docs.select("doc_id", marked.alias("text")))
    return out.select("doc_id", "comment_lines", F.sha2("text", 256).alias("text_sha256"))


_COMMENT = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), m AS (SELECT doc_id, pos, CASE WHEN (pos // 7) % 2 = 0 THEN '// ' || line ELSE line END AS line FROM l
), c AS (SELECT *, regexp_matches(trim(line), '^(//|#)') AS com FROM m
), r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM com AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(com) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c)
), g AS (SELECT doc_id, run, min(pos) AS pos, count(*) AS n, any_value(com) AS com, string_agg(line, chr(10) ORDER BY pos) AS whole FROM r GROUP BY 1, 2)
SELECT doc_id, coalesce(sum(CASE WHEN com AND n >= 5 THEN n END), 0)::BIGINT AS comment_lines,
  sha256(string_agg(CASE WHEN com AND n >= 5 THEN '  [bloque de ' || n || ' líneas de comentarios omitido]' ELSE whole END, chr(10) ORDER BY pos)) AS text_sha256
FROM g GROUP BY doc_id
"""


def sanitize_documents(spark, sf_dir):
    """Documents with every other seven lines as comments, the ninth of every ten thrice, and five newlines after every eleventh."""
    mark = lambda s, i: F.concat(F.when(F.floor(i / 7) % 2 == 0, F.concat(F.lit("// "), s)).otherwise(s), F.when(i % 10 == 8, F.lit("\nagain\nagain\nagain")).otherwise(""), F.when(i % 11 == 10, F.lit("\n\n\n\n")).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))
    out = sanitize.sanitize(docs, comments=True)
    return out.select("doc_id", "lines_collapsed", "blank_runs", "comment_lines", "chars_removed", F.sha2("text", 256).alias("text_sha256"))


_MARKED = r"""
SELECT doc_id, string_agg(CASE WHEN (i // 7) % 2 = 0 THEN '// ' ELSE '' END || line || CASE WHEN i % 10 = 8 THEN repeat(chr(10) || 'again', 3) ELSE '' END || CASE WHEN i % 11 = 10 THEN repeat(chr(10), 4) ELSE '' END, chr(10) ORDER BY i) AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id
"""
_SANITIZE = (
    f"WITH source AS ({_MARKED}), collapsed AS (" + _RUNS.replace("sha256(string_agg(CASE", "(string_agg(CASE").format(key="doc_id", text="text", source="SELECT doc_id, text FROM source") + r"""
), blank AS (SELECT doc_id, lines_collapsed, len(regexp_extract_all(text_sha256, '\n{4,}'))::BIGINT AS blank_runs, regexp_replace(text_sha256, '\n{4,}', chr(10) || chr(10) || chr(10), 'g') AS text FROM collapsed
), stripped AS (""" + _COMMENT.replace("FROM documents\n), m AS (SELECT doc_id, pos, CASE WHEN (pos // 7) % 2 = 0 THEN '// ' || line ELSE line END AS line FROM l", "FROM blank\n), m AS (SELECT doc_id, pos, line FROM l").replace("sha256(string_agg(CASE", "(string_agg(CASE") + r"""
)
SELECT doc_id, lines_collapsed, blank_runs, comment_lines, (strlen(s.text) - strlen(text_sha256))::BIGINT AS chars_removed, sha256(text_sha256) AS text_sha256
FROM source s JOIN blank USING (doc_id) JOIN stripped USING (doc_id)"""
)


def leading_block_dedup(spark, sf_dir):
    """Documents of a source as files; even ids carry the same three lines at the top."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# shared\n// by\n\nall\n"), "text")).otherwise(F.col("text")).alias("text"))
    out = sanitize.dedupe_headers(docs, "source", "doc_id", "doc_id")
    return out.select("doc_id", "header_removed", F.sha2("text", 256).alias("text_sha256"))


_HEADER = r"""
WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN '# shared' || chr(10) || '// by' || chr(10) || chr(10) || 'all' || chr(10) || text ELSE text END AS text FROM documents
), l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls, text FROM t
), c AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i], ' ' || chr(9) || chr(13)) <> '')[3] AS cut FROM l
), b AS (SELECT *, array_to_string(ls[1:cut], chr(10)) AS block, array_to_string(ls[cut + 1:], chr(10)) AS rest FROM c
), f AS (SELECT *, CASE WHEN cut IS NOT NULL THEN min(doc_id) OVER (PARTITION BY source, CASE WHEN cut IS NULL THEN doc_id END, block) END AS first FROM b)
SELECT doc_id, coalesce(first < doc_id, false) AS header_removed,
  sha256(CASE WHEN coalesce(first < doc_id, false) THEN '  [encabezado idéntico al de ' || first || ' — omitido]' || chr(10) || rest ELSE text END) AS text_sha256 FROM f
"""


def paragraph_dedup(spark, sf_dir):
    """Lines of the documents as paragraphs, compared within a source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = sanitize.dedupe_paragraphs(docs, ["source"], ["doc_id"])
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "paragraphs_removed", "bytes_removed")


_PARAGRAPH = r"""
WITH p AS (
  SELECT source, doc_id, unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n[\t\n\f\r ]*\n+')) AS raw, unnest(range(len(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n[\t\n\f\r ]*\n+')))) AS ord FROM documents
), t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS par, regexp_replace(trim(raw, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g') AS key FROM p
), k AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id, ord) AS rn FROM t WHERE par <> ''
), g AS (SELECT doc_id, string_agg(CASE WHEN rn = 1 THEN par END, chr(10) || chr(10) ORDER BY ord) AS text, count(*) FILTER (rn > 1) AS removed, coalesce(sum(strlen(raw)) FILTER (rn > 1), 0) AS bytes FROM k GROUP BY doc_id)
SELECT d.doc_id, sha256(coalesce(g.text, '')) AS text_sha256, coalesce(removed, 0)::BIGINT AS paragraphs_removed, coalesce(bytes, 0)::BIGINT AS bytes_removed FROM documents d LEFT JOIN g USING (doc_id)
"""

_ASCII_TOKENS = "list_filter(string_split_regex(text, '[\\s\\x0B]+'), lambda x: x <> '')"


def pii_token_stats(spark, sf_dir):
    """Tokens of the documents of a source: how many are scanned and masked. Equal tokens of a source are scored once."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    tokens = pii.tokens(docs).groupBy("source", "token").agg(F.count("token").alias("n"), F.sum("n_tokens").alias("all"))
    judged = pii.decide(tokens)
    return judged.groupBy("source").agg(F.sum("all").alias("n_scanned"), F.coalesce(F.sum(F.when(F.col("masked"), F.col("n"))), F.lit(0)).alias("n_masked"))


def pii_top_tags(spark, sf_dir):
    """The pseudonyms of all masked tokens and how often each stands in the documents."""
    tokens = pii.tokens(table(spark, sf_dir, "documents").select("text")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    judged = pii.decide(tokens).where("masked")
    return judged.groupBy(F.regexp_extract("replacement", "(\\[PII_[0-9a-f]{8}\\])", 1).alias("tag")).agg(F.sum("n").alias("n"))


_PII = r"""
WITH t AS (SELECT source, unnest(regexp_extract_all(text, '[^\s\x0B\x{{85}}\p{{Z}}]+')) AS token FROM documents
), n AS (SELECT {source} token, count(*) AS n FROM t GROUP BY ALL
), d AS (SELECT DISTINCT token FROM n
), c AS (SELECT token, regexp_extract(token, '(?s)([\p{{L}}\p{{Nd}}@\-._+](?:.*[\p{{L}}\p{{Nd}}@\-._+])?)', 1) AS core FROM d
), e AS (SELECT token, CASE WHEN regexp_matches(core, '(^|[^\p{{Nd}}])\.$') THEN left(core, length(core) - 1) ELSE core END AS core FROM c
), f AS (SELECT token, core, length(core) AS n, len(regexp_extract_all(core, '\p{{Nd}}')) AS dg, len(regexp_extract_all(core, '\p{{Lu}}')) AS up, len(regexp_extract_all(core, '[.\-_/]')) AS sp,
  (SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length(core) AS p FROM (SELECT unnest(regexp_extract_all(core, '(?s).')) AS ch) GROUP BY ch)) AS h FROM e
), s AS (SELECT token, core, n, CASE WHEN n = 0 THEN 0::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN contains(core, '@') THEN 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN dg / n > 0.3 THEN 0.3::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN sp >= 2 AND dg / n > 0.2 THEN 0.25::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN n >= 10 AND dg > 0 AND dg < n THEN 0.15::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN dg = 0 AND up / n > 0.6 AND n >= 3 THEN 0.15::DOUBLE ELSE 0::DOUBLE END)) END * 0.65::DOUBLE + CASE WHEN n <= 1 THEN 0::DOUBLE ELSE least(1.0::DOUBLE, h / log2(least(n, 26))) END * 0.35::DOUBLE AS score FROM f
), m AS (SELECT token, core, n >= 4 AND NOT starts_with(core, 'PII_') AND score >= 0.62::DOUBLE AS masked FROM s)
"""
_STATS = _PII.format(source="source,") + "SELECT source, sum(n)::BIGINT AS n_scanned, coalesce(sum(n) FILTER (masked), 0)::BIGINT AS n_masked FROM n JOIN m USING (token) GROUP BY source"
_TAGS = _PII.format(source="") + r"""
, v AS (SELECT core, any_value(lower(core)) AS low, sum(n) AS n FROM n JOIN m USING (token) WHERE masked GROUP BY core
), w AS (SELECT n, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen(low)), lambda i: ('0x' || substr(hex(low), (2 * i + 1)::BIGINT, 2))::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS x FROM v)
SELECT '[PII_' || left(lpad(lower(printf('%x', x::UBIGINT)), 16, '0'), 8) || ']' AS tag, sum(n)::BIGINT AS n FROM w GROUP BY 1
"""


def pii_mask_documents(spark, sf_dir):
    """Masked texts of all documents: bytes before and after, tokens scanned and masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.mask_texts(docs, "doc_id")
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_scanned", "n_masked")


_MASK = _PII.format(source="") + r"""
, dt AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s\x0B\x{85}\p{Z}]+')) AS token FROM documents
), j AS (SELECT doc_id, count(*) AS scanned, count(*) FILTER (masked) AS masked, coalesce(sum(14 - strlen(core)) FILTER (masked), 0) AS grown FROM dt JOIN m USING (token) GROUP BY doc_id)
SELECT d.doc_id, (strlen(text) + coalesce(grown, 0))::BIGINT AS n_bytes, coalesce(scanned, 0)::BIGINT AS n_scanned, coalesce(masked, 0)::BIGINT AS n_masked FROM documents d LEFT JOIN j USING (doc_id)
"""

QUERIES = {
    "run_collapse_documents": (run_collapse_documents, _RUNS.format(key="doc_id", text="text", source="SELECT doc_id, text FROM documents")),
    "run_collapse_event_log": (run_collapse_event_log, _RUNS.format(key="user_id", text="text", source=_EVENT_LOG)),
    "blank_run_collapse": (blank_run_collapse, _BLANK),
    "comment_block_strip": (comment_block_strip, _COMMENT),
    "sanitize_documents": (sanitize_documents, _SANITIZE),
    "leading_block_dedup": (leading_block_dedup, _HEADER),
    "paragraph_dedup": (paragraph_dedup, _PARAGRAPH),
    "pii_token_stats": (pii_token_stats, _STATS),
    "pii_top_tags": (pii_top_tags, _TAGS),
    "pii_mask_documents": (pii_mask_documents, _MASK),
}
