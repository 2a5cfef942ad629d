"""Focus: select the parts of a repository that targets name.

Files are rows (path, content) read once; targets are joined with what the files
hold instead of walking the files again for each. Resolvers give rows (target,
source, kind, content); the first resolver with any row for a target wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, folded, like, target_matches, trimmed
from tessera.shipping import materialize

# Directories that are never searched, prose kinds and extensions, and the patterns of headings, dates and tables.
EXCLUDED_DIRS = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "venv", ".idea", ".vscode")
PROSE_KINDS = ("doc-section", "legal-article", "chronological", "bounded-excerpt")
PROSE_EXTENSIONS = ("md", "markdown", "txt", "rst")
MARKDOWN_HEADING = "(?i)^\\s*#{1,6}\\s+.*$"
LEGAL_HEADING = "(?iu)^\\s*(t[íi]tulo|cap[íi]tulo|secci[óo]n|art[íi]culo|inciso)\\s+\\S.*$"
DATED_LINE = "^\\s*\\**\\[?(\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4})\\]?\\**"
KEYWORD = "func|def|class|interface|type|public|private|protected|static|export|async"
WINDOW_BEFORE, WINDOW_AFTER = 10, 10


def included(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Outside the excluded directories, which can be added to but not taken from."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in (*EXCLUDED_DIRS, *extra)]))


def scan_stats(files: DataFrame, path: str = "path") -> DataFrame:
    """Files per excluded directory (the first on the path), and those scanned under a null directory."""
    parts = F.split(path, "/")
    first = F.get(F.array_intersect(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in EXCLUDED_DIRS])), F.lit(0))
    return files.select(first.alias("excluded_dir"), path).groupBy("excluded_dir").agg(F.count_distinct(path).alias("files"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))


def is_prose(kind: Column, path: Column) -> Column:
    """Sections and excerpts are prose, and files by their extension, whatever its case; the extension says nothing of other kinds."""
    return kind.isin(*PROSE_KINDS) | ((kind == "file") & extension(path).isin(*PROSE_EXTENSIONS))


def sections(files: DataFrame, heading: str, key: str = "path", text: str = "content") -> DataFrame:
    """key, section_ord, heading, section: the parts from each heading line to the next of any level; what stands before the first is left out."""
    held = files.select(key, F.split(text, "\n", -1).alias("__lines"))
    held = held.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.get(F.col("__lines"), i).rlike(heading)))
    piece = lambda s, k: F.struct(k.alias("section_ord"), F.get(F.col("__lines"), s).alias("heading"), F.array_join(F.slice("__lines", s + 1, F.coalesce(F.get(F.col("__at"), k + 1), F.size("__lines")) - s), "\n").alias("section"))
    return held.select(key, F.inline(F.transform("__at", piece)))


def matching_sections(files: DataFrame, targets: DataFrame, heading: str, kind: str, key: str = "path", text: str = "content") -> DataFrame:
    """Sections whose heading matches a target. targets (target) are a project's few, so every section meets them all."""
    found = sections(files, heading, key, text)
    wanted = F.broadcast(targets.select("target").distinct())
    hit = found.join(wanted, target_matches(F.col("heading"), F.col("target")))
    return hit.select("target", F.col(key).alias("source"), F.lit(kind).alias("kind"), F.col("section").alias("content"), "section_ord")


def dated_entries(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Dated entries that match a target, of the first file (by key) that has any, joined by a line of dashes. Files without a dated line have none."""
    hit = matching_entries(files, targets, key, text)
    per_file = hit.groupBy("target", "source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "content"))), lambda e: e["content"]), "\n---\n").alias("content"))
    return per_file.groupBy("target").agg(F.min_by(F.struct("source", "content"), "source").alias("first")).select("target", "first.source", F.lit("chronological").alias("kind"), "first.content")


def matching_entries(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    found = sections(files, DATED_LINE, key, text)
    wanted = F.broadcast(targets.select("target").distinct())
    return found.join(wanted, target_matches(F.col("section"), F.col("target"))).select("target", F.col(key).alias("source"), F.col("section").alias("content"), "section_ord")


def table_definitions(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """CREATE TABLE of each target, to the line with a semicolon; the first in path order of .sql files."""
    sql = files.where(F.lower(key).endswith(".sql"))
    wanted = F.broadcast(targets.select("target").distinct())
    statement = F.regexp_extract_all(text, F.lit("(?im)^[ \\t]*(create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w.\"`]+)\\s*\\([^;]*;?[^\\n]*)"), 1)
    named = sql.select(key, F.explode(statement).alias("content")).withColumn("name", F.lower(F.regexp_replace(F.regexp_extract("content", "(?i)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w.\"`]+)", 1), "[\"`]", "")))
    hit = named.join(wanted, F.col("name") == F.lower("target"))
    return hit.groupBy("target").agg(F.min_by(F.struct(F.col(key).alias("source"), "content"), key).alias("f")).select("target", "f.source", F.lit("sql").alias("kind"), "f.content")


def stripped(target: Column) -> Column:
    """A target without the sign of exactness and the brackets of a call."""
    return F.regexp_replace(F.regexp_replace(target, "^=", ""), "\\(\\)$", "")


def first_hits(files: DataFrame, targets: DataFrame, may: Callable[[Column, Column], Column], passes: list[Callable[[Column, Column], Column]], key: str, text: str) -> DataFrame:
    """target, source, at, __lines: the first line that a pass accepts, in the first file (by key) that has one; a later pass counts only where no file has a hit of an earlier one.

    may (content, target) is a cheap test that all passes imply. Lines are
    searched inside the file's row; only a file's own best hit leaves it.
    """
    wanted = F.broadcast(targets.select("target").distinct())
    met = files.select(F.col(key).alias("source"), F.col(text).alias("__text")).join(wanted, may(F.col("__text"), F.col("target")))
    met = met.withColumn("__lines", F.split("__text", "\n", -1))
    places = [F.nullif(F.array_position(F.transform("__lines", lambda s: p(s, F.col("target"))), True), F.lit(0)) for p in passes]
    found = met.select("target", "source", "__lines", F.inline(F.array(F.struct(F.array(*places).alias("__places")))))
    rank = F.coalesce(*[F.when(F.get("__places", F.lit(i)).isNotNull(), i) for i in range(len(passes))])
    found = found.withColumn("__rank", rank).where("__rank is not null").withColumn("at", (F.get("__places", F.col("__rank")) - 1).cast("int"))
    best = found.groupBy("target").agg(F.min_by(F.struct("source", "at", "__lines"), F.struct("__rank", "source")).alias("f"))
    return best.select("target", "f.*")


def declares(line: Column, target: Column) -> Column:
    """line declares target: its name before one of `( < : {`, after a keyword, names and types alone."""
    name = F.concat(F.lit("\\Q"), F.replace(stripped(target), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    return F.rlike(line, F.concat(F.lit(f"(?i)^\\s*(?:{KEYWORD})?[\\s\\w<>\\[\\],.*]*\\b"), name, F.lit("\\b\\s*[(<:{]")))


def holds(line: Column, target: Column) -> Column:
    """line starts with a keyword and holds target; exact and empty targets are held by none."""
    return line.rlike(f"(?i)^\\s*(?:{KEYWORD})\\b") & like(line, stripped(target)) & ~target.startswith("=") & (trimmed(stripped(target)) != "")


def block(lines: str) -> Column:
    """What belongs to the first of lines: to the end of its braces, or the deeper and blank lines that follow."""
    rest = F.col(lines)
    depth = lambda s: F.regexp_count(s, F.lit("\\{")) - F.regexp_count(s, F.lit("\\}"))
    step = lambda a, s: F.struct((a["d"] + depth(s)).alias("d"), (a["open"] | F.contains(s, F.lit("{"))).alias("open"), (a["n"] + F.when(a["end"], 0).otherwise(1)).alias("n"), (a["end"] | ((a["open"] | F.contains(s, F.lit("{"))) & (a["d"] + depth(s) <= 0))).alias("end"))
    zero = F.struct(F.lit(0).alias("d"), F.lit(False).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("end"))
    brace = F.aggregate(rest, zero, step, lambda a: F.when(a["end"], a["n"]))
    indent = lambda s: F.length(F.regexp_extract(s, "^[ \\t]*", 0))
    base = indent(F.get(rest, F.lit(0)))
    stop = F.get(F.filter(F.sequence(F.lit(1), F.size(rest)), lambda i: F.coalesce((trimmed(F.get(rest, i)) != "") & (indent(F.get(rest, i)) <= base), F.lit(True))), F.lit(0))
    opens = F.contains(F.get(rest, F.lit(0)), F.lit("{")) | F.coalesce(F.get(rest, F.lit(1)).rlike("^\\s*\\{"), F.lit(False))
    n = F.when(opens, F.coalesce(brace, F.size(rest))).otherwise(stop)
    return F.array_join(F.slice(rest, F.lit(1), n), "\n")


def code_blocks_of(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Declarations of symbols: from the line that declares a target, to the end of its braces or of its indentation; first file in path order.

    A declaration has the name, whatever its case, before one of `( < : {`, with
    nothing but a keyword, names and types before it. Targets that no file
    declares, and that are not exact (=), take the first line with a keyword at
    its start that holds them. A block whose first line opens a brace ends where
    the running depth is back at zero; any other takes the deeper or blank lines
    that follow.
    """
    first = first_hits(files, targets, lambda c, t: like(c, stripped(t)), [declares, holds], key, text)
    rest = first.withColumn("__rest", F.slice("__lines", F.col("at") + 1, F.size("__lines")))
    return rest.select("target", "source", F.lit("code-symbol").alias("kind"), block("__rest").alias("content"))



def excerpts(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """The lines around the first that matches a target (ten before, nine after), of the first file that has one; for targets that no line matches and that are not exact, around the first line that holds all their words."""
    words = lambda s, t: word_match(s, t) & ~t.startswith("=")
    first = first_hits(files, targets, lambda c, t: target_matches(c, t) | words(c, t), [target_matches, words], key, text)
    start = F.greatest(F.col("at") - WINDOW_BEFORE, F.lit(0))
    return first.select("target", "source", F.lit("bounded-excerpt").alias("kind"), F.array_join(F.slice("__lines", start + 1, F.col("at") + WINDOW_AFTER - start), "\n").alias("content"))


def word_match(line: Column, target: Column) -> Column:
    """All of the target's words stand in line, in any order; a target without words matches nothing."""
    words = F.filter(F.split(folded(target), SPACE + "+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(folded(line), w))


def json_node(document: Column, path: str) -> Column:
    """The node at a dotted path of object keys, as JSON text; arrays have no keys."""
    return F.get_json_object(document, "$." + path)


def json_value(document: Column, path: Column) -> Column:
    """The node at the dotted object keys of path: strings as they are, others as JSON; null if there is none."""
    # a quoted step of a path cannot hold a quote or a question mark, so such keys are looked up in the object
    step = lambda a, k: F.when(k.rlike("['?]"), F.try_element_at(F.from_json(a, "map<string,string>"), k)).otherwise(F.call_function("get_json_object", a, F.concat(F.lit("$['"), k, F.lit("']"))))
    return F.aggregate(F.split(path, "\\.", -1), document, step)


def by_path(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Files by their path, or for bare names the first of that name in path order; n_matches tells how many had it."""
    named = files.select(key, text, F.regexp_extract(key, "[^/]*$", 0).alias("__name"))
    wanted = targets.select("target").distinct()
    exact = named.join(F.broadcast(wanted), F.col(key) == F.col("target")).select("target", key, text, F.lit(0).alias("rank"))
    bare = named.join(F.broadcast(wanted.where("not contains(target, '/')")), F.col("__name") == F.col("target")).select("target", key, text, F.lit(1).alias("rank"))
    both = exact.unionByName(bare)
    best = both.groupBy("target").agg(F.min_by(F.struct(F.col(key).alias("source"), F.col(text).alias("content")), F.struct("rank", key)).alias("f"), F.count_distinct(key).alias("n_matches"))
    return best.select("target", "f.source", F.lit("file").alias("kind"), "f.content", "n_matches")


def json_targets(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Targets `file#a.b`: the node at the object keys a, b of the file, found as by by_path(). Strings as they are, other nodes as JSON; arrays have no keys. A file that is no JSON has no nodes."""
    asked = targets.select("target").distinct().where("contains(target, '#')").select("target", F.substring_index("target", "#", 1).alias("__file"), F.regexp_replace("target", "^[^#]*#", "").alias("__path"))
    held = by_path(files, asked.select(F.col("__file").alias("target")), key, text).select(F.col("target").alias("__file"), "source", "content")
    found = held.join(F.broadcast(asked), "__file").withColumn("__node", json_value(F.col("content"), F.col("__path"))).where("__node is not null")
    return found.select("target", F.concat("source", F.lit("#"), "__path").alias("source"), F.lit("json-node").alias("kind"), F.col("__node").alias("content"))


def glob_pattern(target: Column) -> Column:
    """Regex of a glob: *, ? and [..]; of `**/x`, only x counts."""
    name = F.regexp_replace(target, "^.*\\*\\*/", "")
    escaped = F.regexp_replace(name, "([\\\\.^$|()+{}])", "\\\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def by_glob(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """All files that a target with * or ? matches: by their whole path if it has a directory (not **), else by their names."""
    wanted = targets.select("target").distinct().where("target rlike '[*?]'").withColumn("__glob", glob_pattern(F.col("target"))).withColumn("__whole", F.contains(F.regexp_replace("target", "\\*\\*/", ""), F.lit("/")))
    name = F.when(F.col("__whole"), F.col(key)).otherwise(F.regexp_extract(key, "[^/]*$", 0))
    return files.select(key, text).join(F.broadcast(wanted), F.rlike(name, F.col("__glob"))).select("target", F.col(key).alias("source"), F.lit("file").alias("kind"), F.col(text).alias("content"))


def directories(files: DataFrame, targets: DataFrame, key: str = "path") -> DataFrame:
    """Listings of directories by their path, with or without a slash at the end, or for bare names the first of that name in path order."""
    wanted = targets.select("target").distinct().withColumn("__dir", F.regexp_replace("target", "/+$", ""))
    index = directory_index(files, key).withColumn("__name", F.regexp_extract("dir", "[^/]*$", 0))
    exact = index.join(F.broadcast(wanted), F.col("dir") == F.col("__dir")).withColumn("rank", F.lit(0))
    bare = index.join(F.broadcast(wanted.where("not contains(__dir, '/')")), F.col("__name") == F.col("__dir")).withColumn("rank", F.lit(1))
    best = exact.unionByName(bare).groupBy("target").agg(F.min_by(F.struct(F.col("dir").alias("source"), F.col("listing").alias("content")), F.struct("rank", "dir")).alias("f"))
    return best.select("target", "f.source", F.lit("dir-index").alias("kind"), "f.content")


def directory_index(files: DataFrame, key: str = "path") -> DataFrame:
    """dir, listing: `dir(n): a, b/, c`, one level, sorted."""
    parts = files.select(F.split(key, "/").alias("p"))
    levels = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("d")).where("size(p) > 1")
    child = levels.select(F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("dir"), F.concat(F.get("p", F.col("d")), F.when(F.col("d") + 1 < F.size("p"), "/").otherwise("")).alias("child"))
    per = child.groupBy("dir").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return per.select("dir", F.concat("dir", F.lit("("), F.size("children"), F.lit("): "), F.array_join("children", ", ")).alias("listing"))


def cascade(resolved: list[DataFrame]) -> DataFrame:
    """Rows of the first resolver, in the order given, that has any for a target."""
    rows = None
    for i, r in enumerate(resolved):
        own = r.select("target", "source", "kind", "content", F.lit(i).alias("prio"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("target").agg(F.min("prio").alias("prio"))
    return rows.join(best, ["target", "prio"])


#: Targets that candidates are looked for by at most: they are written into the plan. With more of them, all files are.
MOST_ASKED = 200


def tree(both: Callable[[Column, Column], Column], tests: list[Column]) -> Column:
    """All of tests under AND or OR, halved again and again: of a chain of hundreds Spark's recursion runs out of stack."""
    half = len(tests) // 2
    return both(tree(both, tests[:half]), tree(both, tests[half:])) if half else tests[0]


def candidates(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """The files (key, text) that a resolver can have a hit in for any of targets, from one scan; of those that only a listing names, the path alone.

    A file's text is folded once for all targets and resolvers. Written to the
    shared folder, since every resolver reads them. With more than MOST_ASKED
    targets, files as they are.
    """
    words = F.filter(F.split(folded(F.col("target")), SPACE + "+"), lambda w: w != "")
    parts = [folded(F.col("target")).alias("fold"), folded(stripped(F.col("target"))).alias("plain"), F.lower("target").alias("lower"), F.regexp_replace("target", "/+$", "").alias("folder"), words.alias("words")]
    asked = targets.select("target").where("target is not null").distinct().select("target", *parts).limit(MOST_ASKED + 1).collect()
    if len(asked) > MOST_ASKED:
        return files
    path, content, name, fold = F.col(key), F.col(text), F.col("__name"), F.col("__fold")
    kept, listed = [F.lit(False)], [F.lit(False)]
    for t in asked:
        target, file = t["target"], t["target"].partition("#")[0]
        kept += [path.isin(target, file) | name.isin(target, file)]
        if "*" in target or "?" in target:
            kept += [F.rlike(path if "/" in target.replace("**/", "") else name, glob_pattern(F.lit(target)))]
        listed += [F.contains(F.concat(F.lit("/"), path), F.lit(f"/{t['folder']}/"))]
        exact = target.startswith("=")
        # a text that holds a target holds its words
        for needles in ([t["plain"]], [t["fold"]] if exact else t["words"] or [t["fold"]]):
            kept += [tree(Column.__and__, [F.contains(fold, F.lit(n)) for n in needles])]
        if exact:
            kept += [F.contains(content, F.lit(target[1:]))]
        kept += [F.col("__sql") & F.contains(F.translate(F.lower(content), '"`', ""), F.lit(t["lower"]))]
    # nothing but ASCII has no accents, and translating costs more than all else
    plain = F.when(F.octet_length(content) == F.length(content), F.lower(content)).otherwise(folded(content))
    # rows of an array of one: else filters are pushed below and evaluate what they use again
    held = files.select(key, text, F.inline(F.array(F.struct(plain.alias("__fold"), F.substring_index(key, "/", -1).alias("__name"), F.lower(key).endswith(".sql").alias("__sql")))))
    told = held.select(key, text, F.inline(F.array(F.struct(F.coalesce(tree(Column.__or__, kept), F.lit(False)).alias("__kept"), F.coalesce(tree(Column.__or__, listed), F.lit(False)).alias("__listed")))))
    return materialize(told.where("__kept or __listed").select(key, F.when(F.col("__kept"), content).alias(text)), "focus-candidates")


def resolved(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """target, source, kind, content, prio of every target by the first of all resolvers that finds it: files, directories, JSON nodes, tables, code, sections, legal sections, dated entries, globs, excerpts. The resolvers read the candidates among the files."""
    return resolved_in(candidates(files, targets, key, text), targets, key, text)


def resolved_in(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """As resolved(), with a scan of all files for every resolver."""
    dated = dated_entries(files, targets, key, text)
    return cascade([
        by_path(files, targets, key, text), directories(files, targets, key), json_targets(files, targets, key, text),
        table_definitions(files, targets, key, text), code_blocks_of(files, targets, key, text),
        matching_sections(files.where(extension(F.col(key)).isin(*PROSE_EXTENSIONS)), targets, MARKDOWN_HEADING, "doc-section", key, text),
        matching_sections(files, targets, LEGAL_HEADING, "legal-article", key, text), dated, by_glob(files, targets, key, text), excerpts(files, targets, key, text),
    ])


def rendered_by_kind(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """target, text, n_sources: the FOCUS header, and each block as its kind has it: files bare, listings indented, others below their source; blank lines between. n_sources: different sources."""
    body = F.when(F.col("kind") == "file", F.col("content")).when(F.col("kind") == "dir-index", F.concat(F.lit("  "), "content")).otherwise(F.concat(F.lit("  ("), "source", F.lit(")\n"), "content"))
    per = blocks.groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", body.alias("body")))), lambda b: b["body"]), "\n\n").alias("body"), F.count_distinct("source").alias("n_sources"))
    out = targets.select("target").distinct().join(per, "target", "left")
    return out.select("target", F.concat(F.lit("FOCUS:"), "target", F.lit("\n"), F.coalesce("body", F.concat(F.lit("  not found: "), "target")), F.lit("\n")).alias("text"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def rendered(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """target, text: a FOCUS header and the blocks in order of source, or a note that nothing was found."""
    body = blocks.groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "content"))), lambda b: F.concat(F.lit("FILE:"), b["source"], F.lit("\n"), b["content"])), "\n").alias("body"))
    return targets.select("target").distinct().join(body, "target", "left").select("target", F.concat(F.lit("FOCUS:"), "target", F.lit("\n"), F.coalesce("body", F.concat(F.lit("  not found: "), "target"))).alias("text"))

