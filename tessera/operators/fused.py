"""All resolvers of focus targets in one pass over the files.

Every file is read once. Inside its row, each target is held against all
resolvers; of these, the first that has a hit in this file speaks for it, since a
later one cannot win the cascade through it. What leaves the file are those hits,
as one array of structs. They are written once, and the cascade is an aggregate
of them by target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import folded, target_matches
from tessera.operators import focus
from tessera.shipping import materialize

#: Targets of a call at most: a project's few. They are written into the plan.
MOST_TARGETS = 200
#: Children that a listing names; the number before them counts all.
LISTED = 1_000

KINDS = ("file", "dir-index", "json-node", "sql", "code-symbol", "doc-section", "legal-article", "chronological", "file", "bounded-excerpt")
_FILE, _DIR, _JSON, _SQL, _CODE, _SECTION, _LEGAL, _DATED, _GLOB, _EXCERPT = range(10)
#: Resolvers that give all hits of all files; the others give those of one file.
_ALL = (_SECTION, _LEGAL, _GLOB)
_HIT = "struct<prio:int,rank:int,source:string,ord:int,content:string,rest:array<string>>"
_TABLE = '(?im)^[ \\t]*(create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w."`]+)\\s*\\([^;]*;?[^\\n]*)'


def _hit(prio: int, source: Column, content: Column, rank: Column | int = 0, at: Column | int = 0, rest: Column | None = None) -> Column:
    whole = [F.lit(prio).alias("prio"), (rank if isinstance(rank, Column) else F.lit(rank)).cast("int").alias("rank"), source.alias("source"), (at if isinstance(at, Column) else F.lit(at)).cast("int").alias("ord"), content.cast("string").alias("content")]
    return F.struct(*whole, (F.lit(None) if rest is None else rest).cast("array<string>").alias("rest"))


def _one(where: Column, hit: Column) -> Column:
    """An array of one hit, or of none."""
    return F.when(where, F.array(hit)).otherwise(F.array()).cast(f"array<{_HIT}>")


def section_parts(lines: Column, heading: str) -> Column:
    """array of (ord, heading, section): the parts of lines from each heading to the next."""
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(heading))
    # bound once: the places are used by every part
    held = F.transform(F.array(at), lambda a: F.transform(a, lambda s, k: F.struct(k.alias("ord"), F.get(lines, s).alias("heading"), F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(a, k + 1), F.size(lines)) - s), "\n").alias("section"))))
    return held[0]


def _sections(prio: int, lines: Column, heading: str, target: Column, by: str, source: Column) -> Column:
    found = F.filter(section_parts(lines, heading), lambda s: target_matches(s[by], target))
    return F.transform(found, lambda s: _hit(prio, source, s["section"], at=s["ord"])).cast(f"array<{_HIT}>")


def _places(lines: Column, passes: list, target: Column) -> Column:
    """(rank, at): the first pass with a line, and that line; null if no pass has any."""

    def place(accepts) -> Column:
        return F.nullif(F.array_position(F.transform(lines, lambda s: F.coalesce(accepts(s, target), F.lit(False))), True), F.lit(0))

    first = F.array(*[place(p) for p in passes])
    rank = lambda a: F.array_position(F.transform(a, lambda x: x.isNotNull()), True) - 1
    return F.transform(F.array(first), lambda a: F.when(rank(a) >= 0, F.struct(rank(a).cast("int").alias("rank"), (F.get(a, rank(a).cast("int")) - 1).cast("int").alias("at"))))[0]


def file_hits(files: DataFrame, targets: list[str], key: str = "path", text: str = "content") -> DataFrame:
    """target, prio, rank, source, ord, content: what each file has for each target, by the first resolver that has any in it.

    One scan, and no exchange. For listings, a row is a child (content) of the
    directory (source).
    """
    fold_text = folded(F.col(text))
    base = files.select(F.col(key).alias("source"), F.col(text).alias("content"), F.split(text, "\n", -1).alias("lines"), fold_text.alias("fold"), F.regexp_extract(key, "[^/]*$", 0).alias("name"), F.split(key, "/").alias("parts"))
    met = base.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    t, source, name, parts = F.col("target"), F.col("source"), F.col("name"), F.col("parts")
    bare = ~F.contains(t, F.lit("/"))
    # a folder by its path, or by its name: the first in path order, so the shortest of this file's
    folder = F.regexp_replace(t, "/+$", "")
    depth = F.size(parts) - 1
    paths = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    by_path = F.array_position(paths, folder)
    by_name = F.when(~F.contains(folder, F.lit("/")), F.array_position(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0))), folder)).otherwise(0)
    json_file, json_path = F.substring_index(t, "#", 1), F.regexp_replace(t, "^[^#]*#", "")
    named_json = F.contains(t, F.lit("#")) & ((source == json_file) | (~F.contains(json_file, F.lit("/")) & (name == json_file)))
    pattern, whole = focus.glob_pattern(t), F.contains(F.regexp_replace(t, "\\*\\*/", ""), F.lit("/"))
    globbed = t.rlike("[*?]") & F.rlike(F.when(whole, source).otherwise(name), pattern)
    # cheap tests first: what no resolver can match in this file goes before lines are looked at
    plain = focus.stripped(t)
    in_text = F.contains(F.col("fold"), folded(plain)) | F.contains(F.col("fold"), folded(t)) | (t.startswith("=") & F.contains(F.col("content"), F.substr(t, F.lit(2))))
    words = F.filter(F.split(folded(t), focus.SPACE + "+"), lambda w: w != "")
    in_words = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.col("fold"), w))
    named = (source == t) | (bare & (name == t))
    met = met.withColumns({"named": named, "dir_at": F.when(depth > 0, F.when(by_path > 0, by_path).otherwise(by_name)).otherwise(0).cast("int"), "dir_rank": F.when(by_path > 0, 0).otherwise(1), "json": named_json, "glob": globbed, "told": F.coalesce(in_text | in_words, F.lit(False))})
    met = met.where(F.col("named") | (F.col("dir_at") > 0) | F.col("json") | F.col("glob") | F.col("told"))
    lines = F.when(F.col("told"), F.col("lines")).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("lines", lines)
    lines = F.col("lines")
    node = focus.json_value(F.col("content"), json_path)
    child = F.concat(F.get(parts, F.col("dir_at")), F.when(F.col("dir_at") + 1 < F.size(parts), "/").otherwise(""))
    dir_path = F.array_join(F.slice(parts, F.lit(1), F.col("dir_at")), "/")
    sql_name = lambda s: F.lower(F.regexp_replace(F.regexp_extract(s, '(?i)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w."`]+)', 1), '["`]', ""))
    statement = F.get(F.filter(F.regexp_extract_all("content", F.lit(_TABLE), 1), lambda s: sql_name(s) == F.lower(t)), F.lit(0))
    excerpt_words = lambda s, x: focus.word_match(s, x) & ~x.startswith("=")
    met = met.withColumns({"node": F.when(F.col("json"), node), "statement": F.when(F.col("told") & F.lower(source).endswith(".sql"), statement), "code": _places(lines, [focus.declares, focus.holds], t)})
    met = met.withColumn("line", F.when(F.col("code").isNull(), _places(lines, [target_matches, excerpt_words], t)))
    start = F.greatest(F.col("line.at") - focus.WINDOW_BEFORE, F.lit(0))
    window = F.array_join(F.slice(lines, start + 1, F.col("line.at") + focus.WINDOW_AFTER - start), "\n")
    prose = focus.extension(source).isin(*focus.PROSE_EXTENSIONS)
    none = F.array().cast(f"array<{_HIT}>")
    hits = [
        _one(F.col("named"), _hit(_FILE, source, F.col("content"), F.when(source == t, 0).otherwise(1))),
        _one(F.col("dir_at") > 0, _hit(_DIR, dir_path, child, F.col("dir_rank"))),
        _one(F.col("node").isNotNull(), _hit(_JSON, F.concat(source, F.lit("#"), json_path), F.col("node"), F.when(source == json_file, 0).otherwise(1))),
        _one(F.col("statement").isNotNull(), _hit(_SQL, source, F.col("statement"))),
        _one(F.col("code").isNotNull(), _hit(_CODE, source, F.lit(None), F.col("code.rank"), F.col("code.at"), F.slice(lines, F.col("code.at") + 1, F.size(lines)))),
        F.when(prose, _sections(_SECTION, lines, focus.MARKDOWN_HEADING, t, "heading", source)).otherwise(none),
        _sections(_LEGAL, lines, focus.LEGAL_HEADING, t, "heading", source),
        _sections(_DATED, lines, focus.DATED_LINE, t, "section", source),
        _one(F.col("glob"), _hit(_GLOB, source, F.col("content"))),
        _one(F.col("line").isNotNull(), _hit(_EXCERPT, source, window, F.col("line.rank"))),
    ]
    # the first resolver with a hit; the others are not evaluated. A keyword's line counts only where no file declares, so it doesn't silence the rest
    first = none
    for h in reversed(hits):
        first = F.when(F.size(h) > 0, h).otherwise(first)
    told = met.select("target", F.inline(first))
    return told.select("target", "prio", "rank", "source", "ord", F.when(F.col("prio") == _CODE, focus.block("rest")).otherwise(F.col("content")).alias("content"))


def fused(files: DataFrame, targets: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """target, source, kind, content, prio: what focus.resolved() gives, from one scan of files.

    Of listings, LISTED children are named, and all are counted. More than
    MOST_TARGETS different targets are an error. Null targets, paths and
    contents have no hits.
    """
    asked = [r["target"] for r in targets.select("target").where("target is not null").distinct().limit(MOST_TARGETS + 1).collect()]
    if len(asked) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    found = file_hits(files.where(F.col(key).isNotNull() & F.col(text).isNotNull()), sorted(asked), key, text)
    found = materialize(found, "focus-hits")
    best = found.groupBy("target").agg(F.min(F.struct("prio", "rank", "source")).alias("best"))
    # one row a target, of which there are few
    won = found.join(F.broadcast(best), "target").where((F.col("prio") == F.col("best.prio")) & (F.col("prio").isin(*_ALL) | ((F.col("rank") == F.col("best.rank")) & (F.col("source") == F.col("best.source"))))).drop("best")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("prio"))
    single = won.where(~F.col("prio").isin(_DIR, _DATED)).select("target", "source", kind.alias("kind"), "content", "prio")
    dated = won.where(F.col("prio") == _DATED).groupBy("target", "source", "prio").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda e: e["content"]), "\n---\n").alias("content"))
    children = won.where(F.col("prio") == _DIR).groupBy("target", "source", "prio", F.col("content").alias("child")).agg(F.count("*").alias("n"))
    place = F.row_number().over(focus.Window.partitionBy("target", "source").orderBy("child"))
    named = children.withColumn("place", place)
    listed = named.groupBy("target", "source", "prio").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= LISTED, F.struct("place", "child")))), lambda c: c["child"]), ", ").alias("names"))
    more = F.when(F.col("n") > LISTED, ", ...").otherwise("")
    listed = listed.withColumn("content", F.concat("source", F.lit("("), F.col("n"), F.lit("): "), "names", more))
    rows = [r.select("target", "source", kind.alias("kind"), "content", "prio") for r in (dated, listed)]
    return single.unionByName(rows[0]).unionByName(rows[1])
