"""Delimited text and JSON as sheets of typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

#: Stand for a delimiter and a line end outside quotes while a text is taken apart: no characters of texts.
_CELL, _ROW = "﷐", "﷑"
_CELLS = "map<string,array<array<struct<type:string,value:string>>>>"
_NUMBER = "(?i)^[+-]?(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?$|^[+-]?inf(inity)?$|^nan$"


def delimiter(text: Column, candidates: tuple[str, ...] = (",", "\t")) -> Column:
    """The candidate that occurs most often, of several the first."""
    counts = [F.struct(F.regexp_count(text, F.lit(f"\\Q{d}\\E")).alias("n"), F.lit(-i).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(candidates)]
    return F.greatest(*counts)["d"] if len(counts) > 1 else F.lit(candidates[0])


def quoted_records(text: Column, delim: Column) -> Column:
    """array<array<string>>: the raw cells of text, row by row, with their quotes; delimiters and line ends inside quotes part nothing.

    Every quote opens or closes, so what stands between an even number of them
    and the next is outside. Empty lines are no rows.
    """
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), '"', -1)
    outside = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(F.replace(p, delim, F.lit(_CELL)), F.lit("\n"), F.lit(_ROW))).otherwise(p))
    rows = F.filter(F.split(F.array_join(outside, '"'), _ROW, -1), lambda r: r != "")
    return F.transform(rows, lambda r: F.split(r, _CELL, -1))


def unquoted(cell: Column) -> Column:
    """What a raw cell says; null if a quote stands where none may: inside a bare cell, or single inside a quoted one."""
    inner = F.substr(cell, F.lit(2), F.length(cell) - 2)
    whole = cell.startswith('"') & cell.endswith('"') & (F.length(cell) >= 2) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
    return F.when(whole, F.replace(inner, F.lit('""'), F.lit('"'))).when(~F.contains(cell, F.lit('"')), cell)


def cell_type(value: Column) -> Column:
    return F.when(value.rlike(_NUMBER), "number").otherwise("string")


def parsed_sheets(rows: DataFrame, key: str, text: str = "text", candidates: tuple[str, ...] = (",", "\t")) -> tuple[DataFrame, DataFrame]:
    """(cells: key, sheet, row, col, type, value; errors: key, error) of the texts of rows.

    A text is tried as a JSON object of sheets, each an array of rows of cells
    with type and value; anything else is delimited text, a sheet named Sheet1,
    whose delimiter is the most frequent candidate and whose cells are numbers
    where they read as one. Cells may be quoted and hold delimiters and line
    ends then; rows may differ in length. error: `empty`, or `quotes` for a text
    whose quotes do not pair up or stand inside a bare cell. Null texts are empty.
    """
    held = rows.select(key, F.coalesce(trimmed(F.col(text)), F.lit("")).alias("__text"))
    held = held.withColumn("__json", F.when(F.col("__text").startswith("{"), F.from_json("__text", _CELLS)))
    held = held.withColumn("__sheets", F.when(F.size("__json") > 0, F.col("__json")))
    raw = F.when(F.col("__sheets").isNull(), quoted_records(F.col("__text"), delimiter(F.col("__text"), candidates)))
    held = held.withColumn("__raw", raw)
    held = held.withColumn("__plain", F.transform("__raw", lambda r: F.transform(r, unquoted)))
    bad = F.exists("__plain", lambda r: F.exists(r, lambda c: c.isNull())) | (F.regexp_count("__text", F.lit('"')) % 2 == 1) | F.col("__text").rlike(f"[{_CELL}{_ROW}]")
    error = F.when(F.col("__text") == "", "empty").when(F.col("__sheets").isNull() & bad, "quotes")
    held = held.withColumn("__error", error)
    typed = F.transform("__plain", lambda r: F.transform(r, lambda c: F.struct(cell_type(c).alias("type"), c.alias("value"))))
    sheets = F.coalesce("__sheets", F.create_map(F.lit("Sheet1"), typed))
    cells = held.where("__error is null").select(key, F.explode(sheets).alias("sheet", "__rows"))
    cells = cells.select(key, "sheet", F.posexplode("__rows").alias("row", "__cells")).select(key, "sheet", "row", F.posexplode("__cells").alias("col", "__cell"))
    return cells.select(key, "sheet", "row", "col", "__cell.type", "__cell.value"), held.where("__error is not null").select(key, F.col("__error").alias("error"))
