"""Column functions over texts: lines, runs, accent folding, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, for words and trimming.
SPACE = "[\\s\\u0085\\p{Z}]"
NOT_SPACE = "[^\\s\\u0085\\p{Z}]"

# Accented letters and what they are matched as.
ACCENTED = "áàäâÁÀÄÂéèëêÉÈËÊíìïîÍÌÏÎóòöôÓÒÖÔúùüûÚÙÜÛñÑçÇ"
PLAIN = "aaaaAAAAeeeeEEEEiiiiIIIIooooOOOOuuuuUUUUnNcC".lower()


def trimmed(c: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def folded(c: Column) -> Column:
    """Lower case, without accents: what LIKE matching compares."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def like(haystack: Column, needle: Column) -> Column:
    """Case- and accent-blind substring test; an empty needle matches."""
    return F.contains(folded(haystack), folded(needle))


def like_exact(haystack: Column, needle: Column) -> Column:
    return F.contains(haystack, needle)


def target_matches(haystack: Column, target: Column) -> Column:
    """A target that starts with = matches as it stands, any other blind to case and accents."""
    return F.when(target.startswith("="), like_exact(haystack, F.substr(target, F.lit(2)))).otherwise(like(haystack, target))


def all_words(haystack: Column, needle: Column) -> Column:
    """Every word of needle occurs somewhere, case- and accent-blind."""
    return F.forall(F.filter(F.split(folded(needle), " "), lambda w: w != ""), lambda w: F.contains(folded(haystack), w))


def glob_regex(pattern: str) -> str:
    """Regex of a glob over base names: *, ? and [..]; of `**/x`, only x counts."""
    out, name = "", pattern.rsplit("**/", 1)[-1]
    i = 0
    while i < len(name):
        c = name[i]
        end = name.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > i:
            out += "[" + name[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
        i += 1
    return f"^{out}$"


def glob_matches(path: Column, pattern: str) -> Column:
    """A pattern with a directory (not **) is matched with the whole path, else with the base name."""
    whole = "/" in pattern.replace("**/", "")
    return (path if whole else F.regexp_extract(path, "[^/]*$", 0)).rlike(glob_regex(pattern))


def with_runs(df: DataFrame, items: str, keys: str, out: str) -> DataFrame:
    """Add out: array<struct<start, n>>, the maximal runs of equal neighbours in the array column keys (as long as items)."""
    n = F.size(items)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get(F.col(keys), i).eqNullSafe(F.get(F.col(keys), i - 1)))
    df = df.withColumn("__starts", first)
    runs = F.transform("__starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(F.col("__starts"), k + 1), n) - s).alias("n")))
    return df.withColumn(out, runs).drop("__starts")
