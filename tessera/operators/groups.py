"""Groups of agents: who takes part, in which order, and what the gates say to each; workflows counted with their context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import budget


def discovered(files: DataFrame, path: str = "path") -> DataFrame:
    """group, agent: the folders right below `projects/group/` that have a project.json."""
    found = F.regexp_extract_all(path, F.lit("^projects/([^/]+)/([^/]+)/project\\.json$"), 0)
    parts = F.split(path, "/")
    return files.where(F.size(found) > 0).select(F.get(parts, F.lit(1)).alias("group"), F.get(parts, F.lit(2)).alias("agent")).distinct()


def planned(groups: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """group, place, agent of groups (group, agents: array<string>): the listed agents in their order, or those discovered, by name.

    A group without either has one row with a null agent. An agent that is
    listed twice runs twice. Names inside a group are sorted in its row.
    """
    own = discovered(files, path).groupBy("group").agg(F.array_sort(F.collect_set("agent")).alias("found"))
    all_ = groups.select("group", "agents").join(own, "group", "left")
    agents = F.when(F.size("agents") > 0, F.col("agents")).when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit(None).cast("string")))
    return all_.select("group", F.posexplode(agents).alias("place", "agent"))


def run_group(plan: DataFrame, contexts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """plan with status, error, tokens, text: each agent's context through the gates, in its place.

    contexts: group, agent, tokens, error, text, as gate.gated() leaves them,
    one row an agent. status: `ok`, `stopped` by a gate (error tells by which),
    `missing` (an agent without a context), or `empty` (a group without agents).
    One agent's failure leaves the others as they are, and all keep their
    places. only: run these, in this order, in every group instead of its own.
    """
    if only:
        named = F.array(*[F.lit(a) for a in only])
        plan = plan.select("group").distinct().select("group", F.posexplode(named).alias("place", "agent"))
    both = plan.join(contexts.select("group", "agent", "tokens", "error", "text", F.lit(True).alias("__there")), ["group", "agent"], "left")
    status = F.when(F.col("agent").isNull(), "empty").when(F.col("__there").isNull(), "missing").when(F.col("error").isNotNull(), "stopped").otherwise("ok")
    error = F.when(status == "empty", F.concat(F.lit("no agents in group "), "group")).when(status == "missing", F.concat(F.lit("no project for agent "), "agent")).otherwise(F.col("error"))
    return both.select("group", "place", "agent", status.alias("status"), error.alias("error"), "tokens", F.when(status == "ok", F.col("text")).alias("text"))


def workflow_gate(contexts: DataFrame, workflow: str = "workflow") -> DataFrame:
    """contexts (text, token_limit and a workflow's text) with workflow_tokens, workflow_error, and the workflow, null unless it passes.

    The tokens are those of the context and the workflow together, a line end
    between them; a limit of 0 or none lets all pass. A missing workflow is an
    error of its own.
    """
    tokens = budget.approx_tokens(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col(workflow)))
    missing = F.col(workflow).isNull()
    out = contexts.withColumn("workflow_tokens", F.when(~missing, tokens))
    error = F.when(missing, "no workflow").otherwise(budget.limit_message(F.col("workflow_tokens"), F.col("token_limit")))
    out = out.withColumn("workflow_error", error)
    return out.withColumn(workflow, F.when(F.col("workflow_error").isNull(), F.col(workflow)))
