"""Configuration files as rows, each kind with its own rule for what cannot be read."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pii import Policy

_PRICES = "struct<currency:string,exchange_rate_clp:double,unit:string,providers:map<string,map<string,struct<input:double,output:double>>>,_bad:string>"
_SHAPE = ("digit_ratio_threshold", "digit_ratio_bonus", "separator_min_count", "separator_digit_ratio_threshold", "separator_bonus", "at_symbol_bonus", "long_token_bonus_len", "long_mixed_token_bonus", "upper_run_ratio_threshold", "upper_run_bonus")
_SQL_TYPES = {"float": "double", "int": "int", "str": "string"}


def _parsed(text: str, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def prices(files: DataFrame, root: str = "root", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(prices: root, provider, model, input, output, per, rate; errors: root, error) of price files (root, content).

    There is no default: a file that is missing (null), no JSON, or without
    providers is an error. per: tokens that a price is for, 1,000 unless the
    unit is `per_1m_tokens`.
    """
    held = files.select(root, F.col(content).alias("__text"), _parsed(content, _PRICES).alias("__p"))
    providers = F.col("__p.providers")
    error = F.when(F.col("__text").isNull(), "missing").when(F.col("__p").isNull() | F.col("__p._bad").isNotNull(), "invalid").when(providers.isNull() | (F.size(providers) == 0), "no providers")
    held = held.withColumn("error", error)
    per = F.when(F.col("__p.unit") == "per_1m_tokens", 1_000_000.0).otherwise(1_000.0)
    good = held.where("error is null").select(root, per.alias("per"), F.col("__p.exchange_rate_clp").alias("rate"), F.explode(providers).alias("provider", "__models"))
    rows = good.select(root, "provider", F.explode("__models").alias("model", "__price"), "per", "rate")
    return rows.select(root, "provider", "model", "__price.input", "__price.output", "per", "rate"), held.where("error is not null").select(root, "error")


def policies(files: DataFrame, root: str = "root", content: str = "content") -> DataFrame:
    """root, every number of pii.Policy, and shipped: masking policies (root, content), one row each.

    A file that is missing, no JSON, or has no min_score (or 0) gives the
    shipped policy, whole; any other is taken as it is, what it leaves out
    being 0 or empty.
    """
    kinds = {f.name: _SQL_TYPES[f.type if isinstance(f.type, str) else f.type.__name__] for f in fields(Policy)}
    shape = ",".join(f"{n}:{kinds[n]}" for n in _SHAPE)
    plain = ",".join(f"{n}:{k}" for n, k in kinds.items() if n not in _SHAPE)
    held = files.select(root, _parsed(content, f"struct<pii_masking:struct<{plain},shape_rules:struct<{shape}>>,_bad:string>").alias("__p"))
    own = F.col("__p.pii_masking")
    shipped = F.coalesce(F.col("__p._bad").isNotNull() | (own["min_score"] == 0) | own["min_score"].isNull(), F.lit(True))
    zero = {"double": F.lit(0.0), "int": F.lit(0), "string": F.lit("")}
    told = {n: (own["shape_rules"][n] if n in _SHAPE else own[n]) for n in kinds}
    default = Policy()
    return held.select(root, *[F.when(shipped, F.lit(getattr(default, n)).cast(k)).otherwise(F.coalesce(told[n], zero[k])).alias(n) for n, k in kinds.items()], shipped.alias("shipped"))


def policy_of(row) -> Policy:
    """A row of policies() as a Policy."""
    return Policy(**{f.name: row[f.name] for f in fields(Policy)})
