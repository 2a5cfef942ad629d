"""Repositories, projects and text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.operators.focus import extension, included

# Extensions that text may be written to.
TEXT_EXTENSIONS = ("txt", "md", "json", "yml", "yaml", "xml", "csv", "toml", "ini", "env", "log", "js", "ts", "py", "go", "cs", "java", "php", "rb", "rs", "c", "cpp", "h", "kt", "swift", "sh", "html", "css", "sql")

TASK = "struct<prompt:string,agents:array<string>,skills:array<string>,variables:map<string,string>,focus:array<string>>"
BUDGET = "struct<max_tokens:int,max_tokens_per_run:int,max_monthly_usd:double,on_exceed:string,cache_hint:boolean,circuit_breaker:boolean,token_estimation:boolean,detailed_reports:boolean,context_cache:boolean>"
PROJECT = f"name string, description string, repo string, lang string, default_task string, variables map<string,string>, tasks map<string,{TASK}>, focus array<string>, budget {BUDGET}"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else byte by byte as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below folder) and content of all files outside excluded directories."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1] + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^\\Q{base}\\E", "")
    return found.select(path.alias("path"), decoded(F.col("content")).alias("content")).where(included(F.col("path"), exclude))


def read_projects(spark: SparkSession, folder: str) -> DataFrame:
    """All project.json below a folder; unknown keys are ignored, missing ones null."""
    rows = spark.read.schema(PROJECT).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "project.json").json(folder)
    return rows.withColumn("task_names", F.array_sort(F.map_keys(F.coalesce("tasks", F.create_map().cast(f"map<string,{TASK}>"))))).orderBy("name")


def enabled(flag: Column) -> Column:
    """Switches that are on unless they are off: null is on."""
    return F.coalesce(flag, F.lit(True))


def writable(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def valid_content(path: Column, content: Column) -> Column:
    """JSON has to parse, CSV to have as many fields on each line; other text is valid.

    The parser stops after the first value, so what follows is told by wrapping: nothing but one whole value fits both a list and an object.
    """
    json = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"k":'), content, F.lit("}"))).isNotNull()
    rows = F.filter(F.split(content, "\n", -1), lambda s: trimmed(s) != "")
    arity = F.array_distinct(F.transform(rows, lambda s: F.size(F.split(F.regexp_replace(s, '"[^"]*"', ""), ",", -1))))
    return F.when(extension(path) == "json", json).when(extension(path) == "csv", F.size(arity) <= 1).otherwise(F.lit(True))


def occurrences(text: Column, needle: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("int")


def patched(text: Column, old: Column, new: Column) -> Column:
    """Replaced where old stands exactly once; null where it does not, so that nothing is written by guess."""
    return F.when((F.length(old) > 0) & (occurrences(text, old) == 1), F.replace(text, old, new))


def typed_cells(rows: DataFrame, key: str, line: str, delimiter: str = ",") -> DataFrame:
    """key, row, col, type, value: the cells of delimited text; numbers are what parses as one."""
    lines = rows.select(key, F.posexplode(F.split(line, "\n", -1)).alias("row", "line")).where(F.col("line") != "")
    cells = lines.select(key, "row", F.posexplode(F.split("line", f"\\Q{delimiter}\\E", -1)).alias("col", "value"))
    number = F.trim("value").try_cast("double").isNotNull()
    return cells.select(key, "row", "col", F.when(number, "number").otherwise("string").alias("type"), "value")
