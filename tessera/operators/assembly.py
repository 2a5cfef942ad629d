"""Context assembly: sections of a project put together for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.operators.sanitize import dedupe_paragraphs

SECTIONS = ("header", "agents", "skills", "prompt", "focus", "memory", "instruction")
#: Sections whose paragraphs are told once over all of them; the header and the instruction stay as they are.
SHARED = SECTIONS[1:-1]


def resolved_task(explicit: Column, default: Column, tasks: Column) -> Column:
    """The task asked for, else the default, else the only one there is."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(default, F.lit("")), F.when(F.size(tasks) == 1, F.get(tasks, F.lit(0))))


def merged_variables(project: Column, task: Column) -> Column:
    """Project variables under those of the task."""
    empty = F.create_map().cast("map<string,string>")
    p, t = F.coalesce(project, empty), F.coalesce(task, empty)
    return F.map_concat(F.map_filter(p, lambda k, _: ~F.map_contains_key(t, k)), t)


def injected(text: Column, variables: Column) -> Column:
    """{{NAME}} replaced by the variable of that name, in order of names."""
    pairs = F.array_sort(F.map_entries(variables))
    return F.aggregate(pairs, text, lambda a, e: F.replace(a, F.concat(F.lit("{{"), F.upper(e["key"]), F.lit("}}")), e["value"]))


def undeclared(text: Column) -> Column:
    """Names of placeholders that are still in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\{\\{([A-Z0-9_]+)\\}\\}"), 1))


def section_place() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))


def core_once(parts: DataFrame, by: list[str]) -> DataFrame:
    """parts (section, ord, name, core, text): a core file stays only in the first section that loads it and has text, ahead of the files of that section (ord -1).

    Other parts of the name of a core file of their own section are left out.
    """
    core = parts.where("core and trim(text) <> ''")
    first = core.groupBy(*by, "name").agg(F.min_by(F.struct(*[F.col(c) for c in parts.columns if c not in (*by, "name")]), F.struct(section_place(), "ord")).alias("p"))
    first = first.select(*by, "name", "p.*").withColumn("ord", F.lit(-1).cast(parts.schema["ord"].dataType))
    named = parts.where("core").select(*by, "section", "name").distinct()
    rest = parts.where("not core").join(named, [*by, "section", "name"], "left_anti")
    return first.select(*parts.columns).unionByName(rest.select(*parts.columns))


def told_once(parts: DataFrame, by: list[str]) -> DataFrame:
    """parts (by, section, ord, text) without the paragraphs that an earlier part of the same context has, whatever its section; with paragraphs_removed and bytes_removed.

    section and ord have to tell the parts of a context apart. Header and instruction take no part.
    """
    shared = F.col("section").isin(*SHARED)
    cut = dedupe_paragraphs(parts.where(shared).withColumn("__s", section_place()), by, ["__s", "ord"]).drop("__s")
    rest = parts.where(~shared).withColumns({"paragraphs_removed": F.lit(0).cast("long"), "bytes_removed": F.lit(0).cast("long")})
    return cut.select(*parts.columns, "paragraphs_removed", "bytes_removed").unionByName(rest)


def assembled(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, context: the parts (section, ord, text) joined in order of section and place; blank ones are left out."""
    rows = parts.where("trim(text) <> ''").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(section_place().alias("s"), "ord", "text"))).alias("parts"))
    return rows.select(*by, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("context"))


def numbered_bullets(text: Column) -> Column:
    """Bullets as 1., 2. and so on, from 1 again after each blank line: for local models."""
    lines = F.split(text, "\n", -1)
    step = lambda a, s: F.struct(F.when(F.trim(s) == "", 0).when(s.rlike("^\\s*[-*] "), a["n"] + 1).otherwise(a["n"]).alias("n"), F.concat(a["out"], F.array(F.when(s.rlike("^\\s*[-*] "), F.concat(F.regexp_extract(s, "^\\s*", 0), (a["n"] + 1).cast("string"), F.lit(". "), F.regexp_replace(s, "^\\s*[-*] ", ""))).otherwise(s))).alias("out"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, zero, step, lambda a: F.array_join(a["out"], "\n"))


def memory_block(text: Column) -> Column:
    """Inside of the first fenced memory block; null without one."""
    return F.nullif(F.regexp_extract(text, "(?s)```memory[^\n]*\n(.*?)\n?```", 1), F.lit(""))


def knowledge(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (kind, domain, lang, name) with path and content: the best ranked file, ties by path.

    An exact domain and language rank before any of the fallbacks, to language
    `es` and domain `base`; files without text do not count.
    """
    f = files.where("trim(content) <> ''").select("kind", "name", F.col("domain").alias("f_domain"), F.col("lang").alias("f_lang"), "path", "content")
    rank = F.when(F.col("f_domain") == F.coalesce("domain", F.lit("base")), 0).when(F.col("f_domain") == "base", 2).otherwise(4) + F.when(F.col("f_lang") == F.coalesce("lang", F.lit("es")), 0).otherwise(1)
    hits = wanted.join(f, ["kind", "name"]).withColumn("rank", rank)
    best = hits.groupBy("kind", "domain", "lang", "name").agg(F.min_by(F.struct("path", "content"), F.struct("rank", "path")).alias("b"))
    return best.select("kind", "domain", "lang", "name", "b.*")


def knowledge_files(files: DataFrame, wanted: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """wanted (kind, domain, lang, name) with place, path and content: the file `name.md` of the first of ten places that has one with text.

    Below `kinds/`: 1 domain/i18n/lang, 2 domain/i18n/en, 3 domain/lang,
    4 domain/en, 5 domain, 6 right there, each exactly; then anywhere below
    7 domain/i18n/lang, 8 domain/i18n/en, 9 domain, 10 kinds: the first file in
    the order of a walk, which goes by names folder by folder; a first file
    without text ends its walk. Null and empty domains are `base`, languages
    `es`. Requests meet files by kind and file name, and each walk is a minimum,
    so no listing is made.
    """
    asked = wanted.select("kind", "domain", "lang", "name").distinct()
    fallback = lambda c, v: F.when(F.coalesce(c, F.lit("")) == "", v).otherwise(F.col(c))
    asked = asked.withColumns({"__d": fallback("domain", "base"), "__l": fallback("lang", "es"), "__dir": F.concat("kind", F.lit("s")), "__file": F.concat("name", F.lit(".md"))})
    asked = asked.withColumn("__last", F.regexp_extract("__file", "[^/]*$", 0))
    parts = F.split(path, "/")
    held = files.where(F.col(path).endswith(".md")).select(F.get(parts, F.lit(0)).alias("__dir"), F.element_at(parts, -1).alias("__last"), F.col(path).alias("__path"), parts.alias("__parts"), (F.coalesce(trimmed(F.col(content)), F.lit("")) == "").alias("__blank"))
    at = lambda *steps: F.concat_ws("/", "__dir", *steps)
    d, lang, en, i18n, file = F.col("__d"), F.col("__l"), F.lit("en"), F.lit("i18n"), F.col("__file")
    exact = [F.col("__path") == at(*steps, file) for steps in ((d, i18n, lang), (d, i18n, en), (d, lang), (d, en), (d,), ())]
    bare = ~F.contains(file, F.lit("/"))
    below = [bare & F.startswith(F.col("__path"), F.concat(at(*steps), F.lit("/"))) for steps in ((d, i18n, lang), (d, i18n, en), (d,), ())]
    places = F.filter(F.array(*[F.when(c, i + 1) for i, c in enumerate(exact + below)]), lambda p: p.isNotNull())
    met = asked.join(held, ["__dir", "__last"]).withColumn("place", F.explode(places))
    first = met.groupBy("kind", "domain", "lang", "name", "place").agg(F.min_by(F.struct("__path", "__blank"), "__parts").alias("f")).where("not f.__blank")
    best = first.groupBy("kind", "domain", "lang", "name").agg(F.min(F.struct("place", F.col("f.__path").alias("path"))).alias("b"))
    texts = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return best.select("kind", "domain", "lang", "name", "b.place", "b.path").join(texts, "path")
