"""Keyword search over texts, and the memory log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(text: Column, query: Column) -> Column:
    """Occurrences of a lower-cased query in the lower-cased text, not overlapping."""
    low, q = F.lower(text), F.lower(query)
    return F.when(F.length(q) > 0, (F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.greatest(F.length(q), F.lit(1))).otherwise(0).cast("long")


def score(name: Column, text: Column, query: Column) -> Column:
    """0.6 for a hit in the name, and up to 0.4 for those in the text."""
    n = hits(text, query)
    return F.when(F.contains(F.lower(name), F.lower(query)), F.lit(0.6)).otherwise(F.lit(0.0)) + n / (n + 5) * 0.4


def excerpt(text: Column, query: Column) -> Column:
    """Thirty characters before the first hit and seventy from it on; without a hit, the first hundred."""
    at = F.position(F.lower(query), F.lower(text))
    return F.when(at > 0, F.substr(text, F.greatest(at - 30, F.lit(1)), at - F.greatest(at - 30, F.lit(1)) + 70)).otherwise(F.substr(text, F.lit(1), F.lit(100)))


def first_match_line(text: Column, query: Column) -> Column:
    """Number of the first line with a hit, from 1; 0 if none has."""
    at = F.position(F.lower(query), F.lower(text))
    return F.when(at > 0, F.regexp_count(F.substr(text, F.lit(1), at), F.lit("\n")) + 1).otherwise(0).cast("long")


def keyword_search(docs: DataFrame, query: str, name: str, text: str) -> DataFrame:
    """Rows with a hit in name or text, with score, excerpt and line."""
    q = F.lit(query)
    found = docs.where(F.contains(F.lower(name), F.lower(q)) | F.contains(F.lower(text), F.lower(q)))
    return found.select("*", score(F.col(name), F.col(text), q).alias("score"), excerpt(F.col(text), q).alias("excerpt"), first_match_line(F.col(text), q).alias("line"))


def matches_in_text(docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """key, row, col (bytes from 0): every hit in every line, overlapping ones too, blind to case."""
    q = query.lower()
    lines = docs.select(key, F.posexplode(F.split(F.lower(text), "\n", -1)).alias("row", "line")).where(F.contains("line", F.lit(q)))
    starts = F.filter(F.sequence(F.lit(1), F.length("line") - len(q) + 1), lambda i: F.substr(F.col("line"), i, F.lit(len(q))) == q)
    at = lines.select(key, "row", "line", F.explode(starts).alias("at"))
    return at.select(key, "row", F.octet_length(F.substr("line", F.lit(1), F.col("at") - 1)).alias("col"))


ENTRY_BREAK = "\n\n---\n\n"


def entries(logs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, entry_ord, entry, entry_date: a log's entries; the date leads the first line, after ##, or is null."""
    rows = logs.select(key, F.posexplode(F.split(text, "\\Q" + ENTRY_BREAK + "\\E", -1)).alias("entry_ord", "entry"))
    first = F.regexp_extract("entry", "^\\s*(?:## )?(\\d{4}-\\d{2}-\\d{2})(?=\\s|$)", 1)
    return rows.withColumn("entry_date", F.try_to_date(F.nullif(first, F.lit(""))))


def archive_split(log: DataFrame, now: Column, days: int, date: str = "entry_date") -> DataFrame:
    """log with archived and, for what goes to an archive, its month. Undated entries stay."""
    old = F.coalesce(F.col(date) < F.date_sub(now, days), F.lit(False))
    return log.withColumn("archived", old).withColumn("archive_month", F.when(old, F.date_format(date, "yyyy-MM")))


def read_all(log: DataFrame, key: str) -> DataFrame:
    """key, text: the entries of archive_split() as one text: active ones first, then the archives, newest month first; within each in their order."""
    month = F.coalesce(F.replace("archive_month", F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))
    row = F.struct("archived", (-month).alias("month"), "entry_ord", "entry")
    return log.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda e: e["entry"]), ENTRY_BREAK).alias("text"))


def deleted(date: Column, archived: Column, all_: bool = False, on: str | None = None, since: str | None = None, until: str | None = None, archived_only: bool = False, keep_active: bool = False) -> Column:
    """Whether a memory entry falls under a delete request; undated entries only under `all`."""
    hit = F.lit(all_)
    if on:
        hit = hit | (date == F.to_date(F.lit(on)))
    if since or until:
        hit = hit | ((date >= F.to_date(F.lit(since or "0001-01-01"))) & (date <= F.to_date(F.lit(until or "9999-12-31"))))
    if archived_only:
        hit = hit | archived
    if keep_active:
        hit = hit & archived
    return F.coalesce(hit, F.lit(False))


def deleted_by(entries: DataFrame, requests: DataFrame, key: str = "project") -> tuple[DataFrame, DataFrame]:
    """(requests with deleted, the entries that stay) of delete requests (key, seq, mode, since, until) for logs.

    entries: key, entry_ord, entry_date, archived. mode: `archived` (archives
    alone go), `all`, `date` (the day `since`) or `range` (days since to until;
    both are needed). Days apply to entries that are not archived and have a
    date. An entry is counted by the first request, in order of seq, that it
    falls under. Requests that delete nothing, of a log that is not there or of
    another mode, have 0. A request has one row, its log may have any number: a
    join by key, whose hot ones adaptive execution splits.
    """
    asked = requests.select(F.col(key).alias("__key"), F.col("seq").alias("__seq"), "mode", F.col("since").cast("date").alias("__since"), F.col("until").cast("date").alias("__until"))
    date = F.col("entry_date")
    days = ((F.col("mode") == "date") & (date == F.col("__since"))) | ((F.col("mode") == "range") & date.between(F.col("__since"), F.col("__until")))
    hit = (F.col("mode") == "all") | ((F.col("mode") == "archived") & F.col("archived")) | (~F.col("archived") & days)
    gone = entries.join(asked, (F.col(key) == F.col("__key")) & hit).groupBy(key, "entry_ord").agg(F.min("__seq").alias("seq"))
    counts = gone.groupBy(key, "seq").agg(F.count("*").alias("deleted"))
    told = requests.join(counts, [key, "seq"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)).cast("long"))
    return told, entries.join(gone.select(key, "entry_ord"), [key, "entry_ord"], "left_anti")


def like_top(docs: DataFrame, query: str, name: str, text: str, limit: int = 20) -> DataFrame:
    """The first `limit` rows by name whose name or text holds the query, blind to case, all with score 0.5."""
    q = F.lit(query.lower())
    found = docs.where(F.contains(F.lower(name), q) | F.contains(F.lower(text), q))
    return found.withColumn("score", F.lit(0.5)).orderBy(name).limit(limit)


def fallback_summary(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, summary: first line of the first user turn, at most 80 bytes, and the first three telling lines of assistants.

    Lines that are blank, tables, rules or headings tell nothing.
    """
    lines = lambda role: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct(turn, F.coalesce("text", F.lit("")).alias("text"))))), lambda t: F.transform(F.split(t["text"], "\n", -1), lambda s: F.trim(s))))
    rows = turns.groupBy(conv).agg(lines("user").alias("u"), lines("assistant").alias("a"))
    told = F.slice(F.filter("a", lambda s: (s != "") & ~s.rlike("^(\\||#|-{3,}|={3,}|\\*{3,})")), 1, 3)
    first = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(F.coalesce(F.get("u", F.lit(0)), F.lit("")), "UTF-8"), 1, 80).cast("string")), "�+$", "")
    return rows.select(conv, F.array_join(F.filter(F.concat(F.array(first), told), lambda s: s != ""), "\n").alias("summary"))


def fuzzy_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries (query) with name and n_matches: the name itself, or the only one that contains the query; null where several do or none.

    names (name) is configuration: a few rows.
    """
    both = queries.select("query").distinct().join(F.broadcast(names.select("name").distinct()), F.contains(F.lower("name"), F.lower("query")), "left")
    per = both.groupBy("query").agg(F.count("name").alias("n_matches"), F.min("name").alias("one"), F.bool_or(F.col("name") == F.col("query")).alias("exact"))
    name = F.when(F.coalesce("exact", F.lit(False)), F.col("query")).when(F.col("n_matches") == 1, F.col("one"))
    return per.select("query", name.alias("name"), "n_matches")


def unmatched(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Exact paths of patterns (path) that no file has: what a delete reports as not found."""
    return patterns.select("path").distinct().join(files.select("path"), "path", "left_anti")
