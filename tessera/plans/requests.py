"""Queries of intents, paths, differences and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diff, intents
from tessera.plans import table

#: Texts put before the first words of a turn, by its conversation's id.
_ASKS = (
    "Crea la carpeta docs/{0} y escribe notas/{1}.md con esto: ",
    "please edit src/{1}.py, \"lib/a{0}.go\" and delete nothing: ",
    "Guarda el informe en 'salida{0}.pdf' sin sobreescribir; ",
    "append it to log{0}.txt and overwrite x{1}.csv: ",
    "put together the folder out/{0}/{1} and fix C:\\tmp\\b.c: ",
    "",
)


def messages(spark, sf_dir):
    """The turns of all conversations, most of them after words that ask for something."""
    def ask(form):
        parts = []
        for piece in form.replace("{0}", "\x00c\x00").replace("{1}", "\x00t\x00").split("\x00"):
            parts.append(F.col("conv_id").cast("string") if piece == "c" else F.col("turn").cast("string") if piece == "t" else F.lit(piece))
        return F.concat(*parts)

    asks = F.get(F.array(*[ask(form) for form in _ASKS]), (F.col("conv_id") % len(_ASKS)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(asks, F.coalesce("text", F.lit(""))).alias("text"))


def _literal(form):
    sql = "'" + form.replace("'", "''") + "'"
    return sql.replace("{0}", "' || conv_id || '").replace("{1}", "' || turn || '")


_MESSAGES = "m AS (SELECT conv_id, turn, [" + ", ".join(_literal(f) for f in _ASKS) + f"][(conv_id % {len(_ASKS)} + 1)::INT] || coalesce(text, '') AS text FROM conversations)"


def _sql(pattern):
    return "'" + pattern.replace("'", "''") + "'"


_PARTS = f"WITH {_MESSAGES}, c AS (SELECT *, string_split_regex(text, {_sql(intents.CLAUSE_BREAK)}) AS cs FROM m)"


def save_intents(spark, sf_dir):
    """Folders and files that messages ask to make, and how."""
    i, how = intents.save_intent(F.col("text")), intents.save_modifiers(F.col("text"))
    out = messages(spark, sf_dir).select("conv_id", "turn", i.alias("i"), how.alias("h"))
    return out.select("conv_id", "turn", F.array_join("i.directories", "|").alias("directories"), F.array_join("i.files", "|").alias("files"), F.col("h.append").alias("append"), F.col("h.overwrite").alias("overwrite"))


_VERBS = _sql(intents.whole_words(intents.CREATE_VERBS))
_SAVE = f"""{_PARTS}, a AS (SELECT *, list_filter(cs, lambda c: regexp_matches(c, {_VERBS})) AS act FROM c)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(act, lambda c: regexp_matches(c, {_sql(intents.FOLDER)})), lambda c: trim(regexp_extract(c, {_sql(intents.FOLDER)}, 1), '"''')), '|') AS directories,
  array_to_string(list_transform(list_filter(act, lambda c: NOT regexp_matches(c, {_sql(intents.FOLDER)}) AND regexp_matches(c, {_sql(intents.PATH)})), lambda c: trim(regexp_extract(c, {_sql(intents.PATH)}, 1), '"''')), '|') AS files,
  regexp_matches(text, {_sql(intents.whole_words(intents.APPEND))}) AS append,
  CASE WHEN regexp_matches(text, {_sql(intents.whole_words(intents.KEEP))}) THEN false WHEN regexp_matches(text, {_sql(intents.whole_words(intents.OVERWRITE))}) THEN true END AS overwrite FROM a"""


def edit_intents(spark, sf_dir):
    """Files that messages ask to change."""
    out = messages(spark, sf_dir).select("conv_id", "turn", intents.edit_intent(F.col("text")).alias("i"))
    return out.select("conv_id", "turn", F.col("i.asked").alias("asked"), F.array_join("i.files", "|").alias("files"))


_EDIT = f"""{_PARTS}, a AS (SELECT *, list_filter(cs, lambda c: regexp_matches(c, {_sql(intents.whole_words(intents.EDIT_VERBS))})) AS act FROM c)
SELECT conv_id, turn, len(act) > 0 AS asked, array_to_string(list_transform(flatten(list_transform(act, lambda c: regexp_extract_all(c, {_sql(intents.PATH)}, 1))), lambda f: trim(f, '"''')), '|') AS files FROM a"""


def path_resolution(spark, sf_dir):
    """A path for each document, of every form, among folders named by source and language."""
    docs = table(spark, sf_dir, "documents")
    folders = docs.select(F.concat(F.lit("repo/"), "source", F.lit("/"), "lang").alias("path")).union(docs.select(F.concat(F.lit("repo/all/"), "source")))
    forms = [F.concat(F.lit("/abs/../x//"), "doc_id", F.lit(".md")), F.concat("source", F.lit("\\f.md")), F.concat("lang", F.lit("/g.md")), F.concat(F.lit("new"), "doc_id", F.lit("/h.md")), F.concat(F.lit("a/./b/"), "doc_id"), F.concat(F.lit("bare"), "doc_id", F.lit(".txt")), F.lit("C:\\x.txt"), F.lit("")]
    requests = docs.select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % len(forms)).cast("int")).alias("requested"))
    return intents.resolved_paths(requests, folders, root="repo").withColumn("kind", intents.target_kind(F.col("requested")))


_RESOLVED = r"""
WITH f AS (SELECT DISTINCT 'repo/' || source || '/' || lang AS path FROM documents UNION SELECT 'repo/all/' || source FROM documents
), k AS (SELECT regexp_extract(path, '[^/]*$') AS dir, count(*)::BIGINT AS n, min(path) AS first FROM f GROUP BY 1
), q AS (SELECT doc_id, source, lang, doc_id % 8 AS form, ['/abs/../x//' || doc_id || '.md', source || '\f.md', lang || '/g.md', 'new' || doc_id || '/h.md', 'a/./b/' || doc_id, 'bare' || doc_id || '.txt', 'C:\x.txt', ''][(doc_id % 8 + 1)::INT] AS requested FROM documents
), j AS (SELECT q.*, coalesce(n, 0) AS n, first FROM q LEFT JOIN k ON dir = CASE form WHEN 1 THEN source WHEN 2 THEN lang WHEN 3 THEN 'new' || doc_id END)
SELECT doc_id, requested, n AS n_matches, CASE WHEN form = 7 THEN 'empty' WHEN form = 6 THEN 'windows path' WHEN n > 1 THEN 'ambiguous' END AS error, 'file' AS kind,
  CASE WHEN form IN (6, 7) OR n > 1 THEN NULL WHEN form = 0 THEN '/x/' || doc_id || '.md' WHEN n = 1 THEN first || CASE form WHEN 1 THEN '/f.md' WHEN 2 THEN '/g.md' ELSE '/h.md' END
    WHEN form = 4 THEN 'repo/a/b/' || doc_id WHEN form = 1 THEN 'repo/' || source || '/f.md' ELSE 'repo/' || requested END AS resolved FROM j
"""


def line_diff(spark, sf_dir):
    """Every document against itself with each fifth line changed and its first line once more at the end."""
    lines = F.split("text", "\n", -1)
    new = F.array_join(F.concat(F.transform(lines, lambda s, i: F.when(i % 5 == 4, F.concat(s, F.lit(" (changed "), i.cast("string"), F.lit(")"))).otherwise(s)), F.slice(lines, F.lit(1), F.lit(1))), "\n")
    return diff.line_diff(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), new.alias("new"))).drop("old", "new")


def markdown_lines(spark, sf_dir):
    """The lines of the documents as Markdown: heading levels and bold runs, with marks by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    marked = F.concat(F.repeat(F.lit("#"), (F.col("at") % 5).cast("int")), F.when(F.col("at") % 5 == 0, "").otherwise(" "), F.replace("line", F.lit(" t"), F.lit(" **t")))
    out = docs.select("doc_id", "at", F.inline(F.array(intents.markdown_line(marked))))
    return out.groupBy("doc_id").agg(F.sum("level").cast("long").alias("levels"), F.sum(F.size("runs")).cast("long").alias("n_runs"), F.sum(F.size(F.filter("runs", lambda r: r["bold"]))).cast("long").alias("n_bold"), F.sum(F.aggregate("runs", F.lit(0), lambda a, r: a + F.when(r["bold"], F.length(r["text"])).otherwise(0))).cast("long").alias("bold_chars"))


_MARKDOWN = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), k AS (SELECT doc_id, CASE WHEN i % 5 BETWEEN 1 AND 3 THEN i % 5 ELSE 0 END AS level, CASE i % 5 WHEN 4 THEN '#### ' ELSE '' END || replace(line, ' t', ' **t') AS body FROM l
), r AS (SELECT doc_id, level, unnest(string_split(body, '**')) AS run, unnest(range(len(string_split(body, '**')))) AS j FROM k
), s AS (SELECT doc_id, count(*) FILTER (run <> '') AS n, count(*) FILTER (run <> '' AND j % 2 = 1) AS b, coalesce(sum(length(run)) FILTER (j % 2 = 1), 0) AS c FROM r GROUP BY 1
), t AS (SELECT doc_id, sum(level) AS levels FROM k GROUP BY 1)
SELECT doc_id, levels::BIGINT AS levels, n::BIGINT AS n_runs, b::BIGINT AS n_bold, c::BIGINT AS bold_chars FROM s JOIN t USING (doc_id)
"""

QUERIES = {
    "save_intents": (save_intents, _SAVE),
    "edit_intents": (edit_intents, _EDIT),
    "path_resolution": (path_resolution, _RESOLVED),
    "line_diff": (line_diff, None),
    "markdown_lines": (markdown_lines, _MARKDOWN),
}
