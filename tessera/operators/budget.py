"""Token estimates, prices, limits, spend, history and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The shipped prices in USD per 1,000 tokens, the rate to CLP, and the cache estimate's bounds.
PRICES = [("anthropic", "claude", 0.003, 0.015), ("google", "gemini", 0.00125, 0.005), ("openai", "gpt-5", 0.005, 0.015)]
CLP_RATE = 950.0
CACHE_SHARE, CACHE_FLOOR = 0.9, 1024


def prices(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """provider, model, input, output: a few rows of configuration, so joins may always broadcast it."""
    return F.broadcast(spark.createDataFrame(rows or PRICES, "provider string, model string, input double, output double"))


def approx_tokens(text: Column) -> Column:
    """Bytes by four, rounded down; null text has none."""
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0)).cast("long")


def divisor(unit: str) -> float:
    return 1_000_000.0 if unit == "1m" else 1_000.0


def costs(counts: DataFrame, price_rows: list[tuple], tokens: str = "tokens", rate: float = CLP_RATE, unit: str = "1k") -> DataFrame:
    """counts with provider, model, usd, clp: each row once for each price, by an array of the (few) prices."""
    table = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model"), F.lit(float(i)).alias("price")) for p, m, i, _ in sorted(price_rows)])
    rows = counts.select("*", F.inline(table))
    usd = F.col(tokens) / divisor(unit) * F.col("price")
    return rows.withColumn("usd", usd).withColumn("clp", usd * rate).drop("price")


def priced(usage: DataFrame, price_table: DataFrame, unit: str = "1k") -> DataFrame:
    """usage (provider, model, prompt_tokens, completion_tokens) with usd, prompts at the input and completions at the output price; null where no price is known."""
    joined = usage.join(price_table, ["provider", "model"], "left")
    return joined.withColumn("usd", (F.col("prompt_tokens") * F.col("input") + F.col("completion_tokens") * F.col("output")) / divisor(unit)).drop("input", "output")


def breakdown(parts: DataFrame, by: list[str], component: str = "component", text: str = "text") -> DataFrame:
    """Tokens per component, and their total as component `total`, for each group of by."""
    counted = parts.select(*by, component, approx_tokens(F.col(text)).alias("tokens"))
    rolled = counted.groupBy(*by, component).agg(F.sum("tokens").alias("tokens"))
    total = rolled.groupBy(*by).agg(F.sum("tokens").alias("tokens")).withColumn(component, F.lit("total"))
    return rolled.unionByName(total)


def biggest(parts: DataFrame, by: list[str], component: str = "component", order: str | None = None) -> DataFrame:
    """The component of most tokens per group of by, the first in order on ties."""
    return parts.groupBy(*by).agg(F.min_by(F.struct(component, "tokens"), F.struct(-F.col("tokens"), F.col(order or component))).alias("top")).select(*by, "top.*")


def savings(without: Column, with_: Column) -> Column:
    """Per cent saved; 0 if there was nothing to save."""
    return F.when(without == 0, F.lit(0.0)).otherwise((1 - with_ / without) * 100)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def over_limit(tokens: Column, limit: Column) -> Column:
    """A limit of 0 or less is none."""
    return (F.coalesce(limit, F.lit(0)) > 0) & (tokens > limit)


def limit_message(tokens: Column, limit: Column) -> Column:
    """The refusal, fixed wording, where tokens are over the limit; else null."""
    text = F.concat(F.lit("ERROR\n\nCurrent context ("), thousands(tokens), F.lit(" tokens) exceeds the configured limit ("), thousands(limit), F.lit(").\n\nSuggestion:\nUse --focus to reduce the included files."))
    return F.when(over_limit(tokens, limit), text)


def circuit_breaker(runs: DataFrame) -> DataFrame:
    """runs (run_tokens, run_limit, month_usd, month_limit, on_exceed, enabled) with run_exceeded, month_exceeded, aborted, breaker_message.

    A run is over above its limit, a month from its limit on; limits of 0 or
    less and a breaker that is off are no limits. A null switch is on, a null
    action warns. Fixed wording of the three messages.
    """
    on = F.coalesce("enabled", F.lit(True))
    run = on & F.coalesce((F.col("run_limit") > 0) & (F.col("run_tokens") > F.col("run_limit")), F.lit(False))
    month = on & F.coalesce((F.col("month_limit") > 0) & (F.coalesce("month_usd", F.lit(0.0)) >= F.col("month_limit")), F.lit(False))
    spent, cap = (F.format_string("%.2f", F.coalesce(c, F.lit(0.0)).cast("double")) for c in ("month_usd", "month_limit"))
    text = (
        F.when(run & month, F.concat(F.lit("Circuit breaker: this run uses "), "run_tokens", F.lit(" tokens (per-run limit: "), "run_limit", F.lit(") and monthly spend is already $"), spent, F.lit(" (limit: $"), cap, F.lit(").")))
        .when(run, F.concat(F.lit("Circuit breaker: this run uses "), "run_tokens", F.lit(" tokens, exceeding the configured per-run limit ("), "run_limit", F.lit(").")))
        .when(month, F.concat(F.lit("Circuit breaker: monthly spend for this project is already $"), spent, F.lit(", reaching or exceeding the configured limit ($"), cap, F.lit(").")))
    )
    aborted = (run | month) & (F.coalesce("on_exceed", F.lit("warn")) == "abort")
    return runs.select("*", run.alias("run_exceeded"), month.alias("month_exceeded"), aborted.alias("aborted"), text.alias("breaker_message"))


def monthly_spend(events: DataFrame, by: list[str], ts: str = "ts", tokens: str = "tokens", usd: str = "usd") -> DataFrame:
    return events.groupBy(*by, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.sum(tokens).alias("tokens"), F.sum(usd).alias("usd"))


def deviation(local: Column, api: Column) -> Column:
    """Per cent that the provider counted more than we did; null without a local count."""
    return F.when(local != 0, (api - local) / local * 100)


def usage_history(events: DataFrame, by: str = "provider") -> DataFrame:
    sums = events.groupBy(by).agg(F.sum("local_tokens").alias("local_tokens"), F.sum("api_tokens").alias("api_tokens"))
    return sums.withColumn("deviation_pct", deviation(F.col("local_tokens"), F.col("api_tokens")))


def accuracy(price_table: DataFrame, history: DataFrame) -> DataFrame:
    """Every priced provider with its history, or nulls where it has none."""
    return price_table.select("provider").distinct().join(history, "provider", "left")


def prefix_fingerprint(static: Column) -> Column:
    """First 16 hex digits of the prefix's SHA-256."""
    return F.substring(F.sha2(static, 256), 1, 16)


def cache_layout(contexts: DataFrame, static: list[str], dynamic: list[str]) -> DataFrame:
    """contexts with full (static parts first), boundary (bytes), prefix_tokens, prefix_hash, reusable_tokens (0 below the floor)."""
    part = lambda cols: F.concat(*[F.coalesce(c, F.lit("")) for c in cols])
    out = contexts.withColumn("__static", part(static))
    out = out.withColumn("full", F.concat("__static", part(dynamic))).withColumn("boundary", F.octet_length("__static").cast("long"))
    out = out.withColumn("prefix_tokens", approx_tokens(F.col("__static"))).withColumn("prefix_hash", F.when(F.col("__static") != "", prefix_fingerprint(F.col("__static"))))
    reusable = F.when(F.col("prefix_tokens") >= CACHE_FLOOR, F.floor(F.col("prefix_tokens") * CACHE_SHARE)).otherwise(0).cast("long")
    return out.withColumn("reusable_tokens", reusable).drop("__static")


def stable_prefix(runs: DataFrame, by: str, order: str, prefix_hash: str = "prefix_hash") -> DataFrame:
    """runs with stable: same prefix, not empty, as in the run before."""
    return runs.withColumn("stable", F.coalesce(F.col(prefix_hash) == F.lag(prefix_hash).over(Window.partitionBy(by).orderBy(order)), F.lit(False)))


def group_rollup(reports: DataFrame, group: str = "group", agent: str = "agent") -> DataFrame:
    """Per group: agents, failed agents, tokens, and tokens saved by agents that saved any."""
    saved = F.col("raw_tokens") - F.col("tokens")
    return reports.groupBy(group).agg(
        F.count_distinct(agent).alias("agents"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when((F.col("raw_tokens") > 0) & (saved > 0), saved)), F.lit(0)).alias("saved_tokens"),
    )


def window_usage(used: Column, estimate: Column, window: Column) -> Column:
    """Per cent of the context window: by real usage where there is some, else by the estimate."""
    return F.when(window > 0, F.coalesce(F.nullif(used, F.lit(0)), estimate) / window * 100)
