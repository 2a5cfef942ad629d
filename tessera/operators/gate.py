"""The gated context: focus and memory are sanitized and masked, the whole is counted and held against breaker and limit.

A context is a row. All of it, the dedup of headers between the blocks of one
focus text included, happens inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lines, trimmed
from tessera.operators import budget, pii, sanitize
from tessera.shipping import materialize

MARK = "FOCUS:"


def focus_blocks(text: Column) -> Column:
    """struct<preamble, blocks: array<struct<name, content>>> of a text with `FOCUS:<name>` lines. Without a mark all is preamble; a mark on the last line is no block."""
    at = F.instr(text, MARK)
    parts = F.split(F.substr(text, at + len(MARK)), "\n" + MARK, -1)
    block = lambda p: F.struct(F.substring_index(p, "\n", 1).alias("name"), F.substr(p, F.instr(p, "\n") + 1).alias("content"))
    blocks = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\n"))), block)
    none = F.array().cast("array<struct<name:string,content:string>>")
    return F.struct(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text).alias("preamble"), F.when(at > 0, blocks).otherwise(none).alias("blocks"))


def joined_focus(focus: Column) -> Column:
    """The text of focus_blocks(): what was split is put together as it was, line ends between blocks included."""
    return F.concat(focus["preamble"], F.array_join(F.transform(focus["blocks"], lambda b: F.concat(F.lit(MARK), b["name"], F.lit("\n"), b["content"])), "\n"))


def dedupe_blocks(df: DataFrame, focus: str) -> DataFrame:
    """Blocks that start with the same text, through the third non-blank line, as an earlier block of theirs have a mark in its place. Adds headers_removed."""

    def head(b: Column) -> Column:
        rows = lines(b["content"])
        filled = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: trimmed(F.get(rows, i)) != "")
        return F.get(filled, F.lit(sanitize.HEADER_LINES - 1)) + 1

    held = df.withColumn("__split", focus_blocks(F.col(focus))).withColumn("__cuts", F.transform("__split.blocks", head))
    held = held.withColumn("__heads", F.transform("__split.blocks", lambda b, i: F.array_join(F.slice(lines(b["content"]), F.lit(1), F.coalesce(F.get("__cuts", i), F.lit(0))), "\n")))
    first = lambda i: F.when(F.get("__cuts", i).isNotNull(), F.array_position("__heads", F.get("__heads", i)).cast("int") - 1)
    held = held.withColumn("__firsts", F.transform("__split.blocks", lambda b, i: first(i)))

    def block(b: Column, i: Column) -> Column:
        mark = F.format_string(sanitize.HEADER, F.get("__split.blocks", F.get("__firsts", i))["name"])
        rest = F.array_join(F.slice(lines(b["content"]), F.get("__cuts", i) + 1, F.size(lines(b["content"]))), "\n")
        return F.struct(b["name"].alias("name"), F.when(F.get("__firsts", i) < i, F.concat(mark, rest)).otherwise(b["content"]).alias("content"))

    later = F.size(F.filter(F.transform("__firsts", lambda f, i: f < i), lambda x: x))
    out = held.withColumn("headers_removed", F.greatest(F.coalesce(later, F.lit(0)), F.lit(0)).cast("long"))
    out = out.withColumn(focus, joined_focus(F.struct(F.col("__split.preamble").alias("preamble"), F.transform("__split.blocks", block).alias("blocks"))))
    return out.drop("__split", "__cuts", "__heads", "__firsts")


def sanitize_sections(contexts: DataFrame, focus: str = "focus", memory: str = "memory", comments: bool = False) -> DataFrame:
    """Focus loses repeated headers and noise, memory noise; other sections stay. Adds lines_removed (headers count one), blank_removed, comments_removed, chars_removed, sums of both. Null sections stay null."""
    counts = {"lines_collapsed": "lines_removed", "blank_runs": "blank_removed", "comment_lines": "comments_removed", "chars_removed": "chars_removed"}
    out = sanitize.sanitize(dedupe_blocks(contexts, focus), focus, comments=comments).withColumnsRenamed({c: f"__f_{c}" for c in counts})
    out = sanitize.sanitize(out, memory, comments=comments).withColumnsRenamed({c: f"__m_{c}" for c in counts})
    sums = {to: F.coalesce(f"__f_{c}", F.lit(0)) + F.coalesce(f"__m_{c}", F.lit(0)) for c, to in counts.items()}
    sums["lines_removed"] += F.col("headers_removed")
    return out.withColumns(sums).drop("headers_removed", *[f"__{s}_{c}" for s in "fm" for c in counts])


def mask_sections(contexts: DataFrame, focus: str = "focus", memory: str = "memory", policy: pii.Policy | None = None) -> DataFrame:
    """Focus and memory with PII-shaped tokens replaced; adds n_scanned and n_masked, sums of both."""
    out = contexts
    for c, name in ((focus, "__f"), (memory, "__m")):
        out = pii.mask_texts(out, [x for x in out.columns if x != c], c, policy).withColumnsRenamed({"n_scanned": f"{name}_s", "n_masked": f"{name}_n"})
    return out.withColumns({"n_scanned": F.col("__f_s") + F.col("__m_s"), "n_masked": F.col("__f_n") + F.col("__m_n")}).drop("__f_s", "__f_n", "__m_s", "__m_n")


def gated(contexts: DataFrame, masking: bool = False, comments: bool = False, policy: pii.Policy | None = None) -> DataFrame:
    """Contexts (head, focus, memory, tail, token_limit, run_limit, month_usd, month_limit, on_exceed, enabled) through all gates.

    In this order: sanitize, mask (only if asked for), count, breaker, limit.
    Adds the counts of the steps, raw_tokens, tokens, the breaker's columns,
    error (of the first gate that refuses) and text, null where one does.
    Null sections are empty.
    """
    whole = F.concat(*[F.coalesce(c, F.lit("")) for c in ("head", "focus", "memory", "tail")])
    out = sanitize_sections(contexts.withColumn("raw_tokens", budget.approx_tokens(whole)), comments=comments)
    out = mask_sections(out, policy=policy) if masking else out.withColumns({"n_scanned": F.lit(0).cast("long"), "n_masked": F.lit(0).cast("long")})
    out = out.withColumn("text", whole).withColumn("tokens", budget.approx_tokens(F.col("text")))
    out = budget.circuit_breaker(out.withColumn("run_tokens", F.col("tokens"))).drop("run_tokens")
    out = out.withColumn("error", F.when(F.col("aborted"), F.col("breaker_message")).otherwise(budget.limit_message(F.col("tokens"), F.col("token_limit"))))
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def saved_percent(raw: Column, tokens: Column) -> Column:
    """Per cent saved against the raw total; 0 unless that is greater."""
    return F.when((raw > 0) & (raw > tokens), (raw - tokens) / raw * 100).otherwise(F.lit(0.0))


def file_tokens(contexts: DataFrame, by: list[str], focus: str = "focus") -> DataFrame:
    """by, file_ord, name, tokens: a row per block of a focus text."""
    rows = contexts.select(*by, F.posexplode(focus_blocks(F.col(focus))["blocks"]).alias("file_ord", "b"))
    return rows.select(*by, "file_ord", "b.name", budget.approx_tokens(F.col("b.content")).alias("tokens"))


def component_table(components: Column, price_rows: list[tuple], digits: int = 4) -> Column:
    """Markdown table of array<struct<name, tokens>>: a row each with its cost at every input price, and the total. Dollars have `digits` decimals."""
    priced = sorted(price_rows)
    usd = lambda n, p: F.concat(F.lit("$"), F.format_string(f"%.{digits}f", n / F.lit(1000.0) * F.lit(float(p[2]))))
    head = "| Component | Tokens |" + "".join(f" {p[0]} {p[1]} (USD) |" for p in priced) + "\n|---|---|" + "---|" * len(priced) + "\n"
    row = lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), c["tokens"].cast("string"), F.lit(" |"), *[F.concat(F.lit(" "), usd(c["tokens"], p), F.lit(" |")) for p in priced], F.lit("\n"))
    total = F.aggregate(components, F.lit(0).cast("long"), lambda a, c: a + c["tokens"])
    last = F.concat(F.lit("| **TOTAL** | **"), total.cast("string"), F.lit("** |"), *[F.concat(F.lit(" **"), usd(total, p), F.lit("** |")) for p in priced], F.lit("\n"))
    return F.concat(F.lit(head), F.array_join(F.transform(components, row), ""), last)


def report(gated_contexts: DataFrame, name: str, price_rows: list[tuple], digits: int = 4) -> DataFrame:
    """name, report: Markdown of each context of gated() with its sections kept: what went where, and what the gates say. Sections without data are left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("name"), budget.approx_tokens(F.col(c)).alias("tokens")) for c in ("head", "focus", "memory", "tail")])
    files = F.transform(focus_blocks(F.col("focus"))["blocks"], lambda b: F.concat(F.lit("| "), b["name"], F.lit(" | "), budget.approx_tokens(b["content"]).cast("string"), F.lit(" |\n")))
    number = lambda c: F.col(c).cast("string")
    section = lambda cond, title, *body: F.when(cond, F.concat(F.lit(f"## {title}\n\n"), *body, F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("# Budget Report\n\n## Project\n\nProject name: "), F.col(name).cast("string"), F.lit("\n\n**Final tokens sent to the model: "), number("tokens"), F.lit("**\n\n"),
        section(F.col("lines_removed") + F.col("blank_removed") + F.col("comments_removed") > 0, "Sanitizer", F.lit("Lines removed: "), number("lines_removed"), F.lit("\nBlank runs removed: "), number("blank_removed"), F.lit("\nComment lines removed: "), number("comments_removed"), F.lit("\nBytes removed: "), number("chars_removed"), F.lit("\n")),
        section(F.col("n_masked") > 0, "PII Masking", F.lit("Tokens masked: "), number("n_masked"), F.lit(" of "), number("n_scanned"), F.lit("\n")),
        section(F.lit(True), "Token & Cost Breakdown", component_table(parts, price_rows, digits)),
        section(F.size(files) > 0, "Files", F.lit("| File | Tokens |\n|---|---|\n"), F.array_join(files, "")),
        section(F.col("raw_tokens") > F.col("tokens"), "Before and After", F.lit("Tokens before: "), number("raw_tokens"), F.lit("\nTokens after: "), number("tokens"), F.lit("\n")),
        section(F.col("breaker_message").isNotNull(), "Circuit Breaker", F.coalesce("breaker_message", F.lit("")), F.lit("\n")),
        section(F.coalesce("token_limit", F.lit(0)) > 0, "Budget Limit", F.lit("Limit: "), F.coalesce(number("token_limit"), F.lit("")), F.lit("\nExceeded: "), budget.over_limit(F.col("tokens"), F.col("token_limit")).cast("string"), F.lit("\n")),
    )
    return gated_contexts.select(name, text.alias("report"))


def write_reports(reports: DataFrame, name: str, folder: str) -> None:
    """A text file per name, below folder/name=<name>; a second write replaces those of its names alone."""
    reports.select(name, "report").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy(name).text(folder)


def cheapest(costs: DataFrame, by: list[str], usd: str = "usd") -> DataFrame:
    """Per group of by the provider and model of the least positive cost, the first in name on ties."""
    order = F.struct(usd, "provider", "model")
    return costs.where(F.col(usd) > 0).groupBy(*by).agg(F.min(order).alias("c")).select(*by, "c.provider", "c.model", F.col(f"c.{usd}"))


def cost_by_provider(reports: DataFrame, price_rows: list[tuple], group: str) -> DataFrame:
    """group, provider, model, tokens, usd: the costs of a group's agents together; agents that failed (error) cost nothing and are counted in failed."""
    ok = F.when(F.col("error").isNull(), F.col("tokens")).otherwise(0)
    sums = reports.groupBy(group).agg(F.sum(ok).alias("tokens"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return budget.costs(sums, price_rows).drop("clp")


def memoized(inputs: DataFrame, cache: DataFrame, work: Callable[[DataFrame], DataFrame], config: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(inputs with content_key, hit and output, new rows for the cache). cache: content_key, output.

    The key is the SHA-256 of the configuration and the text, so another
    configuration is no hit. work takes (content_key, text) and adds output; it
    sees each text that the cache lacks once. Null texts count as empty.
    """
    key = F.sha2(F.concat(F.lit(config + "\x00"), F.coalesce(text, F.lit(""))), 256)
    keyed = inputs.withColumn("content_key", key)
    missing = keyed.select("content_key", F.coalesce(text, F.lit("")).alias("text")).join(cache.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])
    # written, so that the work is done once for the answer and for the cache
    new = materialize(work(missing).select("content_key", "output"), "memo")
    known = cache.select("content_key", "output", F.lit(True).alias("hit")).unionByName(new.withColumn("hit", F.lit(False)))
    return keyed.join(known, "content_key"), new
