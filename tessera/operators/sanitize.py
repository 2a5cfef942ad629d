"""Noise removal: repeated lines, blank runs, comment blocks, repeated headers and paragraphs.

Line operators work inside each document's row, with array functions over its
lines, so nothing is shuffled. Header and paragraph dedup compare documents and
group by the text that repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines, trimmed, with_runs
from tessera.shipping import materialize

# The time stamp that is left out of comparisons, and the marks that stand for what was removed.
TIMESTAMP = "^\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z?[\\t\\n\\f\\r ]*"
REPEATED = "  [×%d repeticiones idénticas omitidas]"
COMMENTS = "  [bloque de %d líneas de comentarios omitido]"
HEADER = "  [encabezado idéntico al de %s — omitido]\n"

MIN_REPEATS = 3
MIN_COMMENTS = 5
HEADER_LINES = 3


def line_key(line: Column) -> Column:
    """A line without its leading time stamp."""
    return F.regexp_replace(line, TIMESTAMP, "")


def collapse_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Runs of three or more equal lines (time stamps aside, blank ones left alone) become the first and a mark.

    Replaces text and adds lines_collapsed, the lines of the runs less one each. Null texts stay null.
    """
    held = df.withColumn("__lines", lines(F.col(text))).withColumn("__keys", F.transform("__lines", line_key))
    held = with_runs(held, "__lines", "__keys", "__runs")
    long = lambda r: (r["n"] >= MIN_REPEATS) & (trimmed(F.get(F.col("__keys"), r["start"])) != "")
    piece = lambda r: F.when(long(r), F.array(F.get(F.col("__lines"), r["start"]), F.format_string(REPEATED, r["n"]))).otherwise(F.slice("__lines", r["start"] + 1, r["n"]))
    removed = F.aggregate(F.filter("__runs", long), F.lit(0), lambda a, r: a + r["n"] - 1)
    out = held.withColumn(text, F.array_join(F.flatten(F.transform("__runs", piece)), "\n"))
    return out.withColumn("lines_collapsed", F.coalesce(removed, F.lit(0)).cast("long")).drop("__lines", "__keys", "__runs")


def collapse_blanks(df: DataFrame, text: str = "text") -> DataFrame:
    """Four or more newlines become three; adds blank_runs, how many times."""
    counted = df.withColumn("blank_runs", F.coalesce(F.regexp_count(F.col(text), F.lit("\\n{4,}")), F.lit(0)).cast("long"))
    return counted.withColumn(text, F.regexp_replace(F.col(text), "\\n{4,}", "\n\n\n"))


def strip_comments(df: DataFrame, text: str = "text") -> DataFrame:
    """Five or more neighbouring lines that start with // or # become a mark; adds comment_lines, how many went."""
    is_comment = lambda s: trimmed(s).rlike("^(//|#)")
    held = df.withColumn("__lines", lines(F.col(text))).withColumn("__keys", F.transform("__lines", is_comment))
    held = with_runs(held, "__lines", "__keys", "__runs")
    block = lambda r: F.get(F.col("__keys"), r["start"]) & (r["n"] >= MIN_COMMENTS)
    piece = lambda r: F.when(block(r), F.array(F.format_string(COMMENTS, r["n"]))).otherwise(F.slice("__lines", r["start"] + 1, r["n"]))
    removed = F.aggregate(F.filter("__runs", block), F.lit(0), lambda a, r: a + r["n"])
    out = held.withColumn(text, F.array_join(F.flatten(F.transform("__runs", piece)), "\n"))
    return out.withColumn("comment_lines", F.coalesce(removed, F.lit(0)).cast("long")).drop("__lines", "__keys", "__runs")


def sanitize(df: DataFrame, text: str = "text", dedupe_logs: bool = True, strip_blank: bool = True, comments: bool = False) -> DataFrame:
    """The steps in their order, with chars_removed: bytes before less bytes after, negative where marks outgrow what they replace."""
    out = df.withColumn("__before", F.octet_length(text))
    out = collapse_repeats(out, text) if dedupe_logs else out.withColumn("lines_collapsed", F.lit(0).cast("long"))
    out = collapse_blanks(out, text) if strip_blank else out.withColumn("blank_runs", F.lit(0).cast("long"))
    out = strip_comments(out, text) if comments else out.withColumn("comment_lines", F.lit(0).cast("long"))
    return out.withColumn("chars_removed", (F.col("__before") - F.octet_length(text)).cast("long")).drop("__before")


def dedupe_headers(files: DataFrame, scope: str, order: str, name: str, text: str = "text") -> DataFrame:
    """A file whose text through the third non-blank line equals that of an earlier file of its scope has it replaced by a mark naming the first.

    order has to be unique within a scope. Adds header_removed. Files with fewer non-blank lines have no such block.
    """
    held = files.withColumn("__lines", lines(F.col(text)))
    filled = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: trimmed(F.get(F.col("__lines"), i)) != "")
    held = held.withColumn("__cut", F.get(filled, F.lit(HEADER_LINES - 1)) + 1)
    held = held.withColumn("__block", F.array_join(F.slice("__lines", F.lit(1), F.coalesce("__cut", F.lit(0))), "\n"))
    first = held.where("__cut is not null").groupBy(scope, F.xxhash64("__block").alias("__hash"), "__block").agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("__first"))
    first = first.select(F.col(scope).alias("__scope"), F.col("__hash"), F.col("__block").alias("__same"), F.col("__first.o").alias("__order"), F.col("__first.n").alias("__name"))
    joined = held.withColumn("__h", F.when(F.col("__cut").isNotNull(), F.xxhash64("__block")))
    joined = joined.join(first, (joined["__h"] == first["__hash"]) & joined[scope].eqNullSafe(first["__scope"]) & (joined["__block"] == first["__same"]), "left")
    later = F.coalesce(F.col(order) > F.col("__order"), F.lit(False))
    rest = F.array_join(F.slice("__lines", F.coalesce("__cut", F.lit(0)) + 1, F.size("__lines")), "\n")
    out = joined.withColumn("header_removed", later).withColumn(text, F.when(later, F.concat(F.format_string(HEADER, F.col("__name").cast("string")), rest)).otherwise(F.col(text)))
    return out.select(*files.columns, "header_removed")


def _pieces(text: Column) -> Column:
    """What stands between the blank lines of a text."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n[\\t\\n\\f\\r ]*\n+", -1)


def paragraphs(text: Column) -> Column:
    """array<struct<paragraph, h1, h2, n_bytes>>: the paragraphs of a text that are not blank; paragraph is trimmed, n_bytes is not.

    h1 and h2 are 64 bits each of the paragraph with its white space collapsed: 128 bits tell paragraphs apart.
    """
    cut = F.transform(_pieces(text), lambda r: F.struct(trimmed(r).alias("paragraph"), F.octet_length(r).cast("long").alias("n_bytes")))
    key = lambda p: F.regexp_replace(p["paragraph"], "[\\s\\u0085\\p{Z}]+", " ")
    filled = F.filter(cut, lambda p: p["paragraph"] != "")
    return F.transform(filled, lambda p: F.struct(p["paragraph"].alias("paragraph"), F.xxhash64(key(p)).alias("h1"), F.xxhash64(F.lit(1), key(p)).alias("h2"), p["n_bytes"].alias("n_bytes")))


def dedupe_paragraphs(df: DataFrame, scope: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Each paragraph of a scope stays where it comes first, by order and its place; documents lose the others.

    Returns df's columns with text put together again (blank line between), paragraphs_removed and bytes_removed.
    order has to tell a scope's documents apart, and neither may be null. Only hashes and places are shuffled
    to find what repeats, and first places of paragraphs that stand once are dropped before they are joined.
    Places and first places are written to the shared folder first: texts are taken apart once to compare them,
    and both sides of the join are plain shuffles, which adaptive execution can split where one paragraph is in
    a third of all documents.
    """
    mine = list(dict.fromkeys([*scope, *order]))
    places = df.select(*mine, F.posexplode(F.transform(paragraphs(F.col(text)), lambda p: F.struct(p["h1"].alias("h1"), p["h2"].alias("h2"), p["n_bytes"].alias("n_bytes")))).alias("par_ord", "p"))
    places = places.select(*mine, "par_ord", F.col("p.h1").alias("__h1"), F.col("p.h2").alias("__h2"), F.col("p.n_bytes").alias("__bytes"))
    places = materialize(places, "paragraph-places").withColumn("__at", F.struct(*order, "par_ord"))
    keys = [*scope, "__h1", "__h2"]
    first = places.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = materialize(first, "first-paragraphs")
    later = places.join(first, keys).where(F.col("__at") != F.col("__first"))
    gone = later.groupBy(*mine).agg(F.collect_set("par_ord").alias("__gone"), F.count("*").alias("paragraphs_removed"), F.sum("__bytes").alias("bytes_removed"))
    out = df.join(gone, mine, "left")
    filled = F.filter(F.transform(_pieces(F.col(text)), trimmed), lambda p: p != "")
    stays = F.when(F.col("__gone").isNull(), filled).otherwise(F.filter(F.transform(filled, lambda p, i: F.when(~F.array_contains("__gone", i), p)), lambda p: p.isNotNull()))
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(stays, "\n\n"))).drop("__gone")
    return out.na.fill(0, ["paragraphs_removed", "bytes_removed"])


def dedupe_names(names: Column) -> Column:
    """Without empty and repeated names, in their first order."""
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))
