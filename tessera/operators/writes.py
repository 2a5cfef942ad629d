"""What a batch of saves and deletes does to a table of files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob_matches
from tessera.operators.search import ENTRY_BREAK
from tessera.sources.files import occurrences, valid_content, writable


def saved(files: DataFrame, requests: DataFrame) -> DataFrame:
    """path, status, content: the outcome of requests (path, content, mode), one for each path.

    mode: `create` (only if there is no such file), `overwrite`, `append` (to what there is) or
    `prepend` (the entry of a log before the others). status: `unsupported` by its extension, `exists`,
    `invalid` (null, or JSON or CSV that would not parse), else `written`. content is null unless written.
    """
    old = files.select("path", F.col("content").alias("__old"), F.lit(True).alias("__there"))
    both = requests.join(old, "path", "left")
    kept = F.coalesce("__old", F.lit(""))
    new = F.when(F.col("mode") == "append", F.concat(kept, "content")).when(F.col("mode") == "prepend", F.concat(F.trim("content"), F.lit(ENTRY_BREAK), kept)).otherwise(F.col("content"))
    both = both.withColumn("__new", new)
    status = (
        F.when(~F.coalesce(writable(F.col("path")), F.lit(False)), "unsupported")
        .when((F.col("mode") == "create") & F.col("__there").isNotNull(), "exists")
        .when(F.col("__new").isNull() | ~F.coalesce(valid_content(F.col("path"), F.col("__new")), F.lit(False)), "invalid")
        .otherwise("written")
    )
    return both.select("path", status.alias("status"), F.when(status == "written", F.col("__new")).alias("content"))


def after(files: DataFrame, outcome: DataFrame) -> DataFrame:
    """files (path, content) as they are once the written ones of saved() are in place: the table to write next.

    saved() knows one request for a path; if several were written, this fails, since one of them would be lost. edited() takes them in order.
    """
    several = F.raise_error(F.concat(F.lit("several saves of "), "path", F.lit(": their order is for edited()")))
    done = outcome.where("status = 'written'").groupBy("path").agg(F.when(F.count("*") > 1, several).otherwise(F.first("content")).alias("content"))
    return files.select("path", "content").join(done.select("path"), "path", "left_anti").unionByName(done)


def edited(files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, seq, status of every request; files (path, content) after all of them).

    requests: path, seq, mode, content, old. The requests of a path are applied
    in order of seq, ties by mode and content, each to what the ones before it
    left: `create`, `overwrite`, `append` and `prepend` as in saved(), and
    `patch`, which puts content in the place of `old`. status: `unsupported`,
    `exists` (a file is there, or was written by a request before), `unmatched`
    or `ambiguous` (a patch whose old text stands nowhere, or more than once),
    `invalid`, `unknown` (any other mode), or `written`; only the last changes
    the file. Each path keeps one row. Requests without a path are unsupported.
    A file and the requests for it meet in one row, as its content does.
    """
    kind = "array<struct<seq:bigint,status:string>>"
    request = F.struct(F.col("seq").cast("long").alias("seq"), "mode", "content", "old")
    asked = requests.groupBy("path").agg(F.sort_array(F.collect_list(request)).alias("asked"))
    both = asked.join(files.select("path", F.col("content").alias("now"), F.lit(True).alias("there")), "path", "left")

    def step(acc, r):
        kept = F.coalesce(acc["now"], F.lit(""))
        stands = F.when(r["old"] == "", 0).otherwise(occurrences(kept, r["old"]))
        new = (
            F.when(r["mode"] == "append", F.concat(kept, r["content"]))
            .when(r["mode"] == "prepend", F.concat(F.trim(r["content"]), F.lit(ENTRY_BREAK), kept))
            .when(r["mode"] == "patch", F.replace(kept, r["old"], r["content"]))
            .otherwise(r["content"])
        )
        status = (
            F.when(~F.coalesce(writable(F.col("path")), F.lit(False)), "unsupported")
            .when(~F.coalesce(r["mode"].isin("create", "overwrite", "append", "prepend", "patch"), F.lit(False)), "unknown")
            .when((r["mode"] == "create") & acc["there"], "exists")
            .when((r["mode"] == "patch") & F.coalesce(stands == 0, F.lit(True)), "unmatched")
            .when((r["mode"] == "patch") & (stands > 1), "ambiguous")
            .when(r["content"].isNull() | ~F.coalesce(valid_content(F.col("path"), new), F.lit(False)), "invalid")
            .otherwise("written")
        )
        # the outcome is bound once, then used for the content
        told = F.transform(F.array(F.struct(new.alias("new"), status.alias("status"))), lambda o: F.struct(F.when(o["status"] == "written", o["new"]).otherwise(acc["now"]).alias("now"), (acc["there"] | (o["status"] == "written")).alias("there"), F.array_append(acc["told"], F.struct(r["seq"].alias("seq"), o["status"].alias("status"))).alias("told")))
        return told[0]

    start = F.struct(F.col("now").alias("now"), F.coalesce("there", F.lit(False)).alias("there"), F.array().cast(kind).alias("told"))
    done = both.select("path", F.aggregate("asked", start, step).alias("acc"))
    outcome = done.select("path", F.inline("acc.told"))
    touched = done.where(F.exists("acc.told", lambda t: t["status"] == "written")).select("path", F.col("acc.now").alias("content"))
    rest = files.select("path", "content").join(touched.select("path"), "path", "left_anti")
    return outcome, rest.unionByName(touched)


def glob_deletes(files: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files (path) that a delete request's patterns name, each once, and the patterns (pattern, files) with how many files each names, none too.

    Patterns are a request's few; each is one test of a path, and no file is paired with them.
    """
    named = F.filter(F.array(*[F.when(glob_matches(F.col("path"), p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())
    hits = files.select("path", named.alias("patterns")).where(F.size("patterns") > 0)
    counts = hits.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("files"))
    asked = files.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return hits.select("path").distinct(), asked.join(counts, "pattern", "left").na.fill(0, ["files"])


def task_output(gated: DataFrame, tasks: list[str], by: str = "project") -> DataFrame:
    """by, output, failed: what the tasks of a job give, joined; those that a gate stopped (error) are left out and counted.

    gated: by, task, text, error. `["*"]` stands for all tasks, by name; else the order is that of the list.
    """
    every = tasks == ["*"]
    wanted = gated if every else gated.where(F.col("task").isin(*tasks))
    place = F.lit(0) if every else F.array_position(F.array(*[F.lit(t) for t in tasks]), F.col("task"))
    part = F.when(F.col("error").isNull(), F.struct(place.alias("at"), "task", F.concat(F.lit("## Task: "), "task", F.lit("\n\n"), "text").alias("text")))
    return wanted.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), ENTRY_BREAK).alias("output"), F.count_if(F.col("error").isNotNull()).alias("failed"))
