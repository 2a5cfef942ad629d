"""Conversations and code in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed, with_runs

# Fences that hold no code, limits, and the signs of languages in order of preference.
IGNORED_FENCES = ("memory", "budget", "system")
HISTORY = 40
BODY_BYTES = 300
LANGUAGES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("go", ("package ", "func ", ":=", "import (", "fmt.", "chan "), ()),
    ("python", ("def ", "import ", "elif ", "self.", "print(", "None", "True", "False"), ("(?m)^\\s*#",)),
    ("rust", ("fn ", "let mut", "impl ", "::<", "match ", "->", "pub struct"), ()),
    ("csharp", ("using System", "namespace ", "public class", "Console.WriteLine", "void Main"), ()),
    ("java", ("public class", "public static void main", "System.out.", "import java."), ()),
    ("kotlin", ("fun ", "val ", "var ", "companion object", "println("), ()),
    ("typescript", ("interface ", ": string", ": number", "export default", "import {", "as const"), ()),
    ("javascript", ("const ", "let ", "=>", "function ", "console.log", "require("), ()),
    ("bash", ("#!/bin/bash", "#!/bin/sh", "echo ", "$(", "fi\n", "then\n"), ()),
    ("sql", ("SELECT ", "FROM ", "WHERE ", "INSERT INTO", "CREATE TABLE", "UPDATE ", "DELETE FROM"), ()),
    ("yaml", (), ("(?m)^[A-Za-z_][\\w-]*:\\s",)),
    ("json", (), ("(?s)^\\s*[\\{\\[].*[\\}\\]]\\s*$",)),
    ("xml", (), ("(?s)^\\s*<\\?xml|^\\s*<[A-Za-z][\\w:-]*[\\s>]",)),
    ("html", ("<!DOCTYPE html", "<html", "<div", "<body"), ()),
]


def exchanges(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, exchange (from 1), turn, user_text, assistant_text: each user turn that an assistant turn follows."""
    order = Window.partitionBy(conv).orderBy(turn)
    pairs = turns.select(conv, turn, "role", F.col("text").alias("user_text"), F.lead("role").over(order).alias("next"), F.lead("text").over(order).alias("assistant_text"))
    pairs = pairs.where("role = 'user' and next = 'assistant'")
    return pairs.select(conv, F.row_number().over(order).alias("exchange"), turn, "user_text", "assistant_text")


def selected(pairs: DataFrame, first: int, last: int, conv: str = "conv_id") -> DataFrame:
    """Exchanges first to last, counted from 1 and clamped to what is there."""
    n = F.count("*").over(Window.partitionBy(conv))
    return pairs.withColumn("__n", n).where((F.col("exchange") >= max(1, first)) & (F.col("exchange") <= F.least(F.col("__n"), F.lit(last)))).drop("__n")


def transcript(pairs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, transcript: exchanges under headings, parted by rules."""
    part = F.concat(F.lit("### You\n\n"), "user_text", F.lit("\n\n### Assistant\n\n"), "assistant_text", F.lit("\n"))
    rows = pairs.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("exchange", part.alias("part")))).alias("parts"))
    return rows.select(conv, F.array_join(F.transform("parts", lambda p: p["part"]), "\n---\n\n").alias("transcript"))


def recent_history(turns: DataFrame, limit: int = HISTORY, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last `limit` turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))
    return turns.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def last_exchange(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, user_text, assistant_text where the last two turns are a user's and an assistant's."""
    order = Window.partitionBy(conv).orderBy(turn)
    rows = turns.select(conv, turn, "role", "text", F.lag("role").over(order).alias("before"), F.lag("text").over(order).alias("user_text"))
    last = rows.groupBy(conv).agg(F.max_by(F.struct("role", "text", "before", "user_text"), turn).alias("l")).select(conv, "l.*")
    return last.where("role = 'assistant' and before = 'user'").select(conv, "user_text", F.col("text").alias("assistant_text"))


def system_apart(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """turns with is_system: the first system message of its conversation, which is sent apart."""
    first = F.row_number().over(Window.partitionBy(conv, F.col("role") == "system").orderBy(turn))
    return turns.withColumn("is_system", (F.col("role") == "system") & (first == 1))


#: Stands for a fence while a text is taken apart: no characters of texts.
_FENCE = "\ufdd2\ufdd3"


def _fenced(df: DataFrame, text: str) -> DataFrame:
    """df with __lines, __fence (is the line a fence) and __no (fences up to and with the line)."""
    held = df.withColumn("__lines", F.split(F.col(text), "\n", -1))
    held = held.withColumn("__fences", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: trimmed(F.get(F.col("__lines"), i)).startswith("```")))
    return held


def code_blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, block_ord, code: closed fenced blocks that are not memory, budget or system, nor blank; without any, the whole text if it looks like code."""
    held = _fenced(df.select(key, text), text)
    opens = F.filter("__fences", lambda _, k: (k % 2 == 0) & (k + 1 < F.size("__fences")))
    held = held.withColumn("__pairs", F.transform(opens, lambda s, k: F.struct(s.alias("a"), F.get(F.col("__fences"), 2 * k + 1).alias("b"))))
    label = lambda p: F.lower(trimmed(F.regexp_replace(trimmed(F.get(F.col("__lines"), p["a"])), "^```", "")))
    code = lambda p: F.regexp_replace(F.array_join(F.slice("__lines", p["a"] + 2, p["b"] - p["a"] - 1), "\n"), "\n+$", "")
    held = held.withColumn("__codes", F.filter(F.transform(F.filter("__pairs", lambda p: ~label(p).isin(*IGNORED_FENCES)), code), lambda c: trimmed(c) != ""))
    held = with_likely_code(held, text)
    whole = F.when(F.col("likely_code"), F.array(trimmed(F.col(text)))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.size("__codes") > 0, F.col("__codes")).otherwise(whole)
    return held.select(key, F.posexplode(found).alias("block_ord", "code"))


def strip_code(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text outside fenced blocks, trimmed."""
    # fences become marks, and every second piece between them is outside; lines are looked at once
    marked = F.array_join(F.transform(F.split(text, "\n", -1), lambda s: F.when(trimmed(s).startswith("```"), _FENCE).otherwise(s)), "\n")
    pieces = F.split(F.concat(F.lit("\n"), marked, F.lit("\n")), _FENCE, -1)
    # each has the line end of the fence before it and of that behind it, or one if it has no line
    inner = F.transform(F.filter(pieces, lambda p, i: (i % 2 == 0) & (F.length(p) > 1)), lambda p: F.substr(p, F.lit(2), F.length(p) - 2))
    return df.withColumn(text, trimmed(F.array_join(inner, "\n")))


def with_likely_code(df: DataFrame, text: str = "text") -> DataFrame:
    """df with likely_code: three signs of code or more, or signs on 35 % of the lines; data and markup at once."""
    body = trimmed(F.coalesce(F.col(text), F.lit("")))
    held = df.withColumn("__body", body)
    any_of = lambda s, words: F.array_contains(F.array(*[F.contains(s, F.lit(w)) for w in words]), True)

    def sign(line: Column) -> Column:
        s = trimmed(line)
        arrow = any_of(s, ["=> {", ")=>", ") =>", ";", '"', "'"]) | s.endswith("=>")
        return s.rlike("[;{}]$") | s.rlike("^(//|/\\*|#!)") | any_of(s, [":=", "==", "!=", "const ", "let ", "var ", "import ", "function", "return "]) | (F.contains(s, F.lit("=>")) & arrow)

    rows = F.split("__body", "\n", -1)
    n = F.size(F.filter(rows, sign))
    likely = (F.col("__body") != "") & (F.col("__body").rlike("^[\\[{<]") | (n >= 3) | (n / F.size(rows) >= 0.35))
    return held.withColumn("likely_code", likely).drop("__body")


def language(code: Column) -> Column:
    """The language with most signs (words count one, patterns two), the first listed on ties; empty without any."""
    scores = [F.struct(sum([F.contains(code, F.lit(w)).cast("int") for w in words] + [code.rlike(p).cast("int") * 2 for p in patterns], F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words, patterns) in enumerate(LANGUAGES)]
    best = F.array_max(F.array(*scores))
    return F.when((trimmed(code) == "") | (best["score"] == 0), F.lit("")).otherwise(best["name"])


def tagged_fences(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the language of their code on fences that open without a tag, where it can be told; all else stays. A bare fence closes a block; what is never closed stays as it is."""
    held = df.withColumn("__lines", F.split(F.col(text), "\n", -1))
    opens = lambda s: s.rlike("^```[A-Za-z0-9_+#.-]*[\\t\\n\\f\\r ]*$")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(state: Column, i: Column) -> Column:
        line, inside = F.get("__lines", i), state["open"] >= 0
        closed = inside & (trimmed(line) == "```")
        start = F.when(closed, -1).when(~inside & opens(line), i).otherwise(state["open"])
        pair = F.struct(state["open"].alias("a"), i.alias("b"))
        return F.struct(start.cast("int").alias("open"), F.when(closed, F.concat(state["pairs"], F.array(pair))).otherwise(state["pairs"]).alias("pairs"))

    pairs = F.aggregate(F.sequence(F.lit(0), F.size("__lines") - 1), F.struct(F.lit(-1).alias("open"), none.alias("pairs")), step, lambda x: x["pairs"])
    held = held.withColumn("__pairs", F.filter(pairs, lambda p: trimmed(F.get("__lines", p["a"])) == "```"))
    code = lambda p: F.array_join(F.slice("__lines", p["a"] + 2, p["b"] - p["a"] - 1), "\n")
    tags = F.map_from_arrays(F.transform("__pairs", lambda p: p["a"]), F.transform("__pairs", lambda p: language(code(p))))
    held = held.withColumn("__tags", tags)
    tag = lambda i: F.coalesce(F.try_element_at("__tags", i), F.lit(""))
    out = F.array_join(F.transform("__lines", lambda s, i: F.when(tag(i) != "", F.concat(F.lit("```"), tag(i))).otherwise(s)), "\n")
    return held.withColumn(text, out).drop("__lines", "__pairs", "__tags")


def range_token(token: Column) -> Column:
    """struct<first, last> of `a-b` or `n`; (1, 0), which selects nothing, for anything else."""
    first = F.regexp_extract(token, "^\\s*(\\d{1,9})\\s*(?:-\\s*(\\d{1,9})\\s*)?$", 1).try_cast("int")
    last = F.regexp_extract(token, "^\\s*(\\d{1,9})\\s*(?:-\\s*(\\d{1,9})\\s*)?$", 2).try_cast("int")
    return F.struct(F.coalesce(first, F.lit(1)).alias("first"), F.coalesce(last, first, F.lit(0)).alias("last"))


def unwrapped(reply: Column) -> Column:
    """Without one fence around the whole."""
    return F.regexp_replace(trimmed(reply), "(?s)^```[^\n]*\n(.*?)\n?```$", "$1")


def tool_call(text: Column, opening: str, closing: str) -> Column:
    """JSON between the first pair of marks; null if it is not JSON."""
    raw = F.regexp_extract(text, f"(?s)\\Q{opening}\\E\\s*(.*?)\\s*\\Q{closing}\\E", 1)
    return F.when(F.try_parse_json(raw).isNotNull(), raw)


def truncated_body(text: Column, limit: int = BODY_BYTES) -> Column:
    """At most `limit` bytes, whole characters, and a mark."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit("... (truncated)"))).otherwise(text)


def role_runs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, start, n: runs of turns by the same role."""
    rows = turns.groupBy(conv).agg(F.transform(F.sort_array(F.collect_list(F.struct(turn, "role"))), lambda t: t["role"]).alias("roles"))
    return with_runs(rows, "roles", "roles", "runs").select(conv, F.inline("runs"))
