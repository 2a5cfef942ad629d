"""Memory, knowledge and projects kept as tables, as a database has them; any Spark source, JDBC too, can give the tables.

memory: project, content, session_date, created_at, archived.
knowledge: kind, domain, lang, name, content, is_custom, active.
projects: name, description, repo, lang, default_task, variables, tasks (both JSON), active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.operators.search import ENTRY_BREAK

# How many entries a context sees, and the mark of an archived one.
RECENT = 50
ARCHIVED = "<!-- archived -->\n"
SEARCH_TOP = 20


def inserted(entries: DataFrame, now: Column) -> DataFrame:
    """Rows of memory for entries (project, content): trimmed, of the day of now, not archived. To be appended to the table."""
    return entries.select("project", trimmed(F.col("content")).alias("content"), F.to_date(now).alias("session_date"), now.alias("created_at"), F.lit(False).alias("archived"))


def archived_before(memory: DataFrame, now: Column, days: int) -> DataFrame:
    """memory with entries of sessions before the cutoff archived; those that are stay so, those without a date stay as they are."""
    return memory.withColumn("archived", F.col("archived") | F.coalesce(F.col("session_date") < F.date_sub(now, days), F.lit(False)))


def recent(memory: DataFrame, limit: int = RECENT) -> DataFrame:
    """project, text: the newest entries of a project that are not archived, newest first; ties by content.

    A rank up to a limit is cut before the shuffle, so a project's row count does not matter.
    """
    newest = Window.partitionBy("project").orderBy(F.desc("created_at"), "content")
    top = memory.where("not archived").select("project", "created_at", "content", F.row_number().over(newest).alias("n")).where(F.col("n") <= limit)
    return top.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda e: e["content"]), ENTRY_BREAK).alias("text"))


def everything(memory: DataFrame) -> DataFrame:
    """project, session_date, created_at, text: all entries, archived ones marked, to be read by project and newest first.

    Rows, and not one text a project: a project may hold any number of entries.
    """
    text = F.when(F.col("archived"), F.concat(F.lit(ARCHIVED), "content")).otherwise(F.col("content"))
    return memory.select("project", "session_date", "created_at", text.alias("text")).orderBy("project", F.desc("session_date"), F.desc("created_at"), "text")


def knowledge_rows(knowledge: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (kind, domain, lang, name) with content: active, of that language or of none; the language's own first, then custom ones, ties by content."""
    have = knowledge.where("active").select("kind", "domain", "name", F.col("lang").alias("__lang"), "is_custom", "content")
    hits = wanted.join(have, ["kind", "domain", "name"]).where((F.col("__lang") == F.col("lang")) | (F.col("__lang") == ""))
    rank = F.struct((F.col("__lang") != F.col("lang")).alias("l"), (~F.col("is_custom")).alias("c"), "content")
    return hits.groupBy("kind", "domain", "lang", "name").agg(F.min_by("content", rank).alias("content"))


def active_projects(projects: DataFrame) -> DataFrame:
    """Active projects by name, with variables as a map and the names of their tasks in order; JSON that cannot be read counts as none."""
    tasks = F.array_sort(F.coalesce(F.json_object_keys("tasks"), F.array().cast("array<string>")))
    kept = projects.where("active").withColumn("variables", F.from_json("variables", "map<string,string>")).withColumn("task_names", tasks)
    return kept.drop("active").orderBy("name")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{Nd}]+"), 0)


def rank(text: Column, query: str) -> Column:
    """Mean over the different words of a query of n / (n + 1), n being how often the text has the word; 0 without words."""
    terms = sorted(set(_query_words(query)))
    found = words(text)

    def share(term: str) -> Column:
        n = F.size(F.filter(found, lambda w: w == term))
        return n / (n + 1)

    return sum(map(share, terms), F.lit(0.0)) / max(1, len(terms))


def _query_words(query: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in query.lower()).split()


def full_text(docs: DataFrame, query: str, text: str, ties: str, limit: int = SEARCH_TOP) -> DataFrame:
    """The `limit` rows of highest rank among those that hold every word of the query, ties by a column; a query without words finds nothing.

    Words are compared whole and without stemming; the rank is this function's own, as that of a database is its engine's.
    """
    terms = sorted(set(_query_words(query)))
    low = F.lower(text)
    held = docs.where(F.lit(bool(terms)))
    for t in terms:  # substrings first: cheaper than words
        held = held.where(F.contains(low, F.lit(t)))
    found = held.where(F.forall(F.array(*[F.lit(t) for t in terms] or [F.lit("")]), lambda t: F.array_contains(words(F.col(text)), t)))
    return found.withColumn("rank", rank(F.col(text), query)).orderBy(F.desc("rank"), ties).limit(limit)
