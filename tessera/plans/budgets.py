"""Queries of token estimates, prices, limits, spend and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budget, sanitize
from tessera.plans import table

_PRICES = "(VALUES ('anthropic', 'claude', 0.003::DOUBLE, 0.015::DOUBLE), ('google', 'gemini', 0.00125::DOUBLE, 0.005::DOUBLE), ('openai', 'gpt-5', 0.005::DOUBLE, 0.015::DOUBLE)) AS p(provider, model, input, output)"


def token_cost_by_source(spark, sf_dir):
    """The report in small: documents without repeated lines, estimated, summed by source, priced for every model."""
    docs = sanitize.collapse_repeats(table(spark, sf_dir, "documents").select("source", "text"))
    sums = docs.groupBy("source").agg(F.sum(budget.approx_tokens(F.col("text"))).alias("tokens"))
    priced = budget.costs(sums, budget.PRICES)
    return priced.select("source", "provider", "model", "tokens", F.round("usd", 9).alias("usd"), F.round("clp", 6).alias("clp"))


_COST = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM line AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
), g AS (SELECT doc_id, run, count(*) AS n, any_value(line) AS line FROM r GROUP BY 1, 2
), b AS (SELECT doc_id, sum(CASE WHEN n >= 3 AND trim(line) <> '' THEN strlen(line) + 1 + strlen('  [×' || n || ' repeticiones idénticas omitidas]') ELSE n * strlen(line) + n - 1 END) + count(*) - 1 AS bytes FROM g GROUP BY 1
), s AS (SELECT source, sum(bytes // 4)::BIGINT AS tokens FROM b JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, provider, model, tokens, round(tokens / 1000.0::DOUBLE * input, 9) AS usd, round(tokens / 1000.0::DOUBLE * input * 950.0::DOUBLE, 6) AS clp FROM s, """ + _PRICES


def component_breakdown(spark, sf_dir):
    """Languages as the components of a source, with their total and the largest."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("component"), "text")
    parts = budget.breakdown(docs, ["source"])
    top = budget.biggest(parts.where("component <> 'total'"), ["source"]).select("source", F.col("component").alias("largest"))
    return parts.join(top, "source")


_BREAKDOWN = """
WITH s AS (SELECT source, lang AS component, sum(strlen(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1, 2
), t AS (SELECT source, 'total' AS component, sum(tokens)::BIGINT AS tokens FROM s GROUP BY 1),
m AS (SELECT source, component AS largest FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY tokens DESC, component) = 1)
SELECT u.source, component, tokens, largest FROM (SELECT * FROM s UNION ALL SELECT * FROM t) u JOIN m ON u.source = m.source
"""


def focus_savings(spark, sf_dir):
    """English documents as the focus of a source: what it saves against all."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", budget.approx_tokens(F.col("text")).alias("t"))
    sums = docs.groupBy("source").agg(F.sum("t").alias("all_tokens"), F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("t"))), F.lit(0)).alias("focus_tokens"))
    return sums.withColumn("savings_pct", F.round(budget.savings(F.col("all_tokens"), F.col("focus_tokens")), 6))


_FOCUS = """
SELECT source, sum(strlen(text) // 4)::BIGINT AS all_tokens, coalesce(sum(CASE WHEN lang = 'en' THEN strlen(text) // 4 END), 0)::BIGINT AS focus_tokens,
  round(CASE WHEN sum(strlen(text) // 4) = 0 THEN 0 ELSE (1 - coalesce(sum(CASE WHEN lang = 'en' THEN strlen(text) // 4 END), 0)::DOUBLE / sum(strlen(text) // 4)) * 100 END, 6) AS savings_pct FROM documents GROUP BY 1
"""


def budget_gate(spark, sf_dir):
    """Every document against a limit of 1,000 tokens: the refusal where it is over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", budget.approx_tokens(F.col("text")).alias("tokens"))
    limit = F.lit(1000)
    return docs.select("doc_id", "tokens", budget.over_limit(F.col("tokens"), limit).alias("over"), budget.limit_message(F.col("tokens"), limit).alias("message"))


_GATE = r"""
SELECT doc_id, (strlen(text) // 4)::BIGINT AS tokens, strlen(text) // 4 > 1000 AS over,
  CASE WHEN strlen(text) // 4 > 1000 THEN 'ERROR' || chr(10) || chr(10) || 'Current context (' || format('{:,}', (strlen(text) // 4)::BIGINT) || ' tokens) exceeds the configured limit (1,000).' || chr(10) || chr(10) || 'Suggestion:' || chr(10) || 'Use --focus to reduce the included files.' END AS message FROM documents
"""


def circuit_breaker(spark, sf_dir):
    """Users as projects: a month's purchases against 500 USD, its event count against 20 per run."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.lit(1).cast("long").alias("tokens"), F.when(F.col("event_type") == "purchase", F.round("value", 2)).otherwise(0.0).cast("decimal(18,2)").alias("usd"))
    months = budget.monthly_spend(events, ["user_id"])
    action = F.when(F.col("user_id") % 2 == 0, "abort")
    runs = months.select("user_id", "month", F.col("tokens").alias("run_tokens"), F.lit(20).alias("run_limit"), F.col("usd").cast("double").alias("month_usd"), F.lit(500.0).alias("month_limit"), action.alias("on_exceed"), F.when(F.col("user_id") % 7 == 0, False).alias("enabled"))
    return budget.circuit_breaker(runs).select("user_id", "month", "run_tokens", "run_exceeded", "month_exceeded", "aborted", "breaker_message")


_BREAKER = r"""
WITH m AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS t, sum((CASE WHEN event_type = 'purchase' THEN round(value, 2) ELSE 0 END)::DECIMAL(18,2))::DOUBLE AS u FROM events GROUP BY 1, 2
), x AS (SELECT *, coalesce(user_id % 7 <> 0, true) AND t > 20 AS r, coalesce(user_id % 7 <> 0, true) AND u >= 500 AS o FROM m)
SELECT user_id, month, t AS run_tokens, r AS run_exceeded, o AS month_exceeded, (r OR o) AND user_id % 2 = 0 AS aborted,
  CASE WHEN r AND o THEN 'Circuit breaker: this run uses ' || t || ' tokens (per-run limit: 20) and monthly spend is already $' || printf('%.2f', u) || ' (limit: $500.00).'
    WHEN r THEN 'Circuit breaker: this run uses ' || t || ' tokens, exceeding the configured per-run limit (20).'
    WHEN o THEN 'Circuit breaker: monthly spend for this project is already $' || printf('%.2f', u) || ', reaching or exceeding the configured limit ($500.00).' END AS breaker_message FROM x
"""


def monthly_spend(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", F.length("props").cast("long").alias("tokens"), F.round("value", 2).cast("decimal(18,2)").alias("usd"))
    return budget.monthly_spend(events, ["user_id"]).withColumn("usd", F.col("usd").cast("double"))


_SPEND = "SELECT user_id, strftime(ts, '%Y-%m') AS month, sum(length(props))::BIGINT AS tokens, sum(round(value, 2)::DECIMAL(18,2))::DOUBLE AS usd FROM events GROUP BY 1, 2"


def usage_deviation(spark, sf_dir):
    """Roles as providers: estimates by bytes against counts by characters, for all priced and unpriced ones."""
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("provider"), budget.approx_tokens(F.col("text")).alias("local_tokens"), F.floor(F.length("text") / 3).cast("long").alias("api_tokens"))
    return budget.usage_history(turns).withColumn("deviation_pct", F.round("deviation_pct", 6))


_USAGE = """SELECT role AS provider, sum(strlen(text) // 4)::BIGINT AS local_tokens, sum(length(text) // 3)::BIGINT AS api_tokens,
  round(CASE WHEN sum(strlen(text) // 4) <> 0 THEN (sum(length(text) // 3) - sum(strlen(text) // 4))::DOUBLE / sum(strlen(text) // 4) * 100 END, 6) AS deviation_pct FROM conversations GROUP BY 1"""


def chat_usage_cost(spark, sf_dir):
    """Each conversation's user text as prompts and assistant text as completions, at the prices of a model chosen by its id; one model has no price."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", budget.approx_tokens(F.col("text")).alias("t"))
    usage = turns.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") != "assistant", F.col("t"))), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("t"))), F.lit(0)).alias("completion_tokens"))
    models = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in (("anthropic", "claude"), ("google", "gemini"), ("openai", "gpt-5"), ("local", "none"))])
    usage = usage.select("*", F.get(models, (F.col("conv_id") % 4).cast("int")).alias("m")).select("conv_id", "prompt_tokens", "completion_tokens", "m.*")
    return budget.priced(usage, budget.prices(spark)).withColumn("usd", F.round("usd", 9))


_CHAT = """
WITH u AS (SELECT conv_id, coalesce(sum(CASE WHEN role <> 'assistant' THEN strlen(text) // 4 END), 0)::BIGINT AS prompt_tokens, coalesce(sum(CASE WHEN role = 'assistant' THEN strlen(text) // 4 END), 0)::BIGINT AS completion_tokens FROM conversations GROUP BY 1
), m AS (SELECT *, ['anthropic', 'google', 'openai', 'local'][(conv_id % 4 + 1)::INT] AS provider, ['claude', 'gemini', 'gpt-5', 'none'][(conv_id % 4 + 1)::INT] AS model FROM u)
SELECT m.*, round((prompt_tokens * input + completion_tokens * output) / 1000.0::DOUBLE, 9) AS usd FROM m LEFT JOIN """ + _PRICES + " ON m.provider = p.provider AND m.model = p.model"


def prefix_fingerprint(spark, sf_dir):
    """System turns as the static part of a conversation's context; stable if it equals that of the conversation before in its project, a hundred conversations."""
    turns = table(spark, sf_dir, "conversations")
    order = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda t: t["text"]), "\n")
    ctx = turns.groupBy("conv_id").agg(order(F.col("role") == "system").alias("static"), order(F.col("role") != "system").alias("dynamic"))
    laid = budget.cache_layout(ctx, ["static"], ["dynamic"])
    slim = laid.select("conv_id", F.floor(F.col("conv_id") / 100).alias("project"), "boundary", "prefix_tokens", "prefix_hash", "reusable_tokens", F.sha2("full", 256).alias("full_sha256"))
    return budget.stable_prefix(slim, "project", "conv_id").drop("project")


_PREFIX = """
WITH c AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), '') AS s, coalesce(string_agg(CASE WHEN role <> 'system' THEN text END, chr(10) ORDER BY turn), '') AS d FROM conversations GROUP BY 1
), h AS (SELECT *, CASE WHEN s <> '' THEN left(sha256(s), 16) END AS hash FROM c)
SELECT conv_id, strlen(s)::BIGINT AS boundary, (strlen(s) // 4)::BIGINT AS prefix_tokens, hash AS prefix_hash, (CASE WHEN strlen(s) // 4 >= 1024 THEN floor((strlen(s) // 4) * 0.9) ELSE 0 END)::BIGINT AS reusable_tokens,
  sha256(s || d) AS full_sha256, coalesce(hash = lag(hash) OVER (PARTITION BY conv_id // 100 ORDER BY conv_id), false) AS stable FROM h
"""


def group_rollup(spark, sf_dir):
    """Sources as groups and languages as agents; agents without a long document count as failed."""
    docs = sanitize.collapse_repeats(table(spark, sf_dir, "documents").withColumn("raw", F.octet_length("text")))
    agents = docs.groupBy(F.col("source").alias("group_name"), F.col("lang").alias("agent")).agg(F.sum(budget.approx_tokens(F.col("text"))).alias("tokens"), F.sum(F.floor(F.col("raw") / 4)).cast("long").alias("raw_tokens"), F.max("raw").alias("longest"))
    agents = agents.withColumn("error", F.when(F.col("longest") < 10_000, "no long document"))
    return budget.group_rollup(agents, "group_name")


_ROLLUP = _COST.split("), s AS (")[0] + r"""
), a AS (SELECT source, lang, sum(bytes // 4)::BIGINT AS tokens, sum(strlen(text) // 4)::BIGINT AS raw, max(strlen(text)) AS longest FROM b JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT source AS group_name, count(DISTINCT lang)::BIGINT AS agents, count(*) FILTER (longest < 10000)::BIGINT AS failed, sum(tokens)::BIGINT AS tokens, coalesce(sum(raw - tokens) FILTER (raw > 0 AND raw > tokens), 0)::BIGINT AS saved_tokens FROM a GROUP BY 1
"""


def context_window_usage(spark, sf_dir):
    """How full a window of 4,096 tokens each conversation's estimate makes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(budget.approx_tokens(F.col("text"))).alias("estimate"))
    return turns.select("conv_id", F.round(budget.window_usage(F.lit(0), F.col("estimate"), F.lit(4096)), 6).alias("used_pct"))


_WINDOW = "SELECT conv_id, round(sum(strlen(text) // 4)::DOUBLE / 4096 * 100, 6) AS used_pct FROM conversations GROUP BY 1"

QUERIES = {
    "token_cost_by_source": (token_cost_by_source, _COST),
    "component_breakdown": (component_breakdown, _BREAKDOWN),
    "focus_savings": (focus_savings, _FOCUS),
    "budget_gate": (budget_gate, _GATE),
    "circuit_breaker": (circuit_breaker, _BREAKER),
    "monthly_spend": (monthly_spend, _SPEND),
    "usage_deviation": (usage_deviation, _USAGE),
    "chat_usage_cost": (chat_usage_cost, _CHAT),
    "prefix_fingerprint": (prefix_fingerprint, _PREFIX),
    "group_rollup": (group_rollup, _ROLLUP),
    "context_window_usage": (context_window_usage, _WINDOW),
}
