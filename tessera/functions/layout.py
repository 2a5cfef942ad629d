"""Texts in lines and pages: greedy breaking, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import SPACE

#: Code points of a line, lines of a page.
WIDTH, PAGE_LINES = 80, 50


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """array<string>: the words of text in lines of `width` code points at most, each as full as can be; a longer word has its own line, and a text without words is one empty line. Null stays null."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(a: Column, w: Column) -> Column:
        fits = F.char_length(a["line"]) + 1 + F.char_length(w) <= width
        joined = F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"))
        broken = F.struct(F.array_append(a["done"], a["line"]).alias("done"), w.alias("line"))
        first = F.struct(a["done"].alias("done"), w.alias("line"))
        return F.when(a["line"].isNull(), first).when(fits, joined).otherwise(broken)

    return F.aggregate(words, start, step, lambda a: F.array_append(a["done"], F.coalesce(a["line"], F.lit(""))))


def pages_of(lines: Column, per_page: int = PAGE_LINES) -> Column:
    """array<int>: on which page, from 1, each block stands whose lines are counted in the array `lines`.

    A block that no longer fits begins the next page, unless the page is empty;
    an empty line follows each block.
    """
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(1).alias("page"), F.lit(0).alias("used"))

    def step(a: Column, n: Column) -> Column:
        turn = (a["used"] + n > per_page) & (a["used"] > 0)
        page = a["page"] + F.when(turn, 1).otherwise(0)
        return F.struct(F.array_append(a["pages"], page).alias("pages"), page.alias("page"), (F.when(turn, 0).otherwise(a["used"]) + n + 1).cast("int").alias("used"))

    return F.aggregate(lines, start, step, lambda a: a["pages"])
