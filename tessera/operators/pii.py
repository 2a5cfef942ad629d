"""PII-shaped tokens: scored by shape and entropy, replaced by stable pseudonyms.

All of it is column expressions. Texts are masked inside their rows, without a
shuffle; only tokens that the policy's numbers leave a chance are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import NOT_SPACE, SPACE


@dataclass(frozen=True)
class Policy:
    """The shipped masking policy."""

    min_score: float = 0.62
    shape_weight: float = 0.65
    entropy_weight: float = 0.35
    min_token_length: int = 4
    hash_length: int = 8
    tag_format: str = "[PII_%s]"
    digit_ratio_threshold: float = 0.3
    digit_ratio_bonus: float = 0.3
    separator_min_count: int = 2
    separator_digit_ratio_threshold: float = 0.2
    separator_bonus: float = 0.25
    at_symbol_bonus: float = 0.5
    long_token_bonus_len: int = 10
    long_mixed_token_bonus: float = 0.15
    upper_run_ratio_threshold: float = 0.6
    upper_run_bonus: float = 0.15


_OTHER = "[^\\p{L}\\p{Nd}@\\-._+]"


def edges(token: Column) -> tuple[Column, Column, Column]:
    """(prefix, core, suffix). A last dot belongs to the core only after a digit."""
    prefix = F.regexp_extract(token, f"^{_OTHER}*", 0)
    core = F.regexp_replace(token, f"^{_OTHER}+|{_OTHER}+$", "")
    suffix = F.when(core == "", "").otherwise(F.regexp_extract(token, f"{_OTHER}*$", 0))
    dotted = core.rlike("(?s)(^|[^\\p{Nd}])\\.$")
    short = F.when(dotted, F.substr(core, F.lit(1), F.length(core) - 1)).otherwise(core)
    return prefix, short, F.when(dotted, F.concat(F.lit("."), suffix)).otherwise(suffix)


def shape_score(core: Column, p: Policy) -> Column:
    n = F.length(core)
    count = lambda pattern: F.regexp_count(core, F.lit(pattern))
    digits, uppers, seps = count("\\p{Nd}"), count("\\p{Lu}"), count("[.\\-_/]")
    share = lambda x: x.cast("double") / F.greatest(n, F.lit(1))
    bonus = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    total = (
        bonus(F.contains(core, F.lit("@")), p.at_symbol_bonus)
        + bonus(share(digits) > p.digit_ratio_threshold, p.digit_ratio_bonus)
        + bonus((seps >= p.separator_min_count) & (share(digits) > p.separator_digit_ratio_threshold), p.separator_bonus)
        + bonus((n >= p.long_token_bonus_len) & (digits > 0) & (digits < n), p.long_mixed_token_bonus)
        + bonus((digits == 0) & (share(uppers) > p.upper_run_ratio_threshold) & (n >= 3), p.upper_run_bonus)
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def entropy_score(core: Column) -> Column:
    """Shannon entropy of the characters over the most that so many characters of 26 could have, summed in code point order."""
    n = F.length(core)
    chars = F.array_sort(F.array_distinct(F.split(core, "")))
    ratio = lambda c: (F.length(core) - F.length(F.replace(core, c, F.lit("")))).cast("double") / n
    h = F.aggregate(chars, F.lit(0.0), lambda a, c: a - ratio(c) * F.log2(ratio(c)))
    most = F.log2(F.least(n, F.lit(26)).cast("double"))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / most)))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits, in two halves of 32 bits since products of 64 would overflow."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexes), F.lit(2))
    codes = F.when(F.length(hexes) > 0, F.transform(at, lambda i: F.conv(F.substr(hexes, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    low = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        y = x * 435
        return F.struct((s["hi"] * 435 + x * 256 + F.shiftright(y, 32)).bitwiseAND(low).alias("hi"), y.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(codes, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def pseudonym(core: Column, p: Policy) -> Column:
    """The same tag for the same value, whatever its case."""
    return F.format_string(p.tag_format, F.substring(fnv1a(F.lower(core)), 1, p.hash_length))


def may_mask(token: Column, p: Policy) -> Column:
    """False where a token cannot reach the least score: one without digit and @ gets at most the upper-case bonus and all of the entropy."""
    most = p.shape_weight * min(1.0, max(0.0, p.upper_run_bonus)) + p.entropy_weight
    return token.rlike("[@\\p{Nd}]") if most < p.min_score - 1e-9 else F.lit(True)


def _score(core: Column, p: Policy) -> Column:
    return shape_score(core, p) * p.shape_weight + entropy_score(core) * p.entropy_weight


def _masked(core: Column, score: Column, p: Policy) -> Column:
    """Tags are not masked again."""
    tag = p.tag_format.split("%s")[0].lstrip("[")
    return (F.length(core) >= p.min_token_length) & ~core.startswith(tag) & (score >= p.min_score)


def decide(tokens: DataFrame, policy: Policy | None = None, token: str = "token") -> DataFrame:
    """tokens with core, score, masked and replacement. Tags are not masked again."""
    p = policy or Policy()
    prefix, core, suffix = edges(F.col(token))
    # inline() of one struct, and not plain columns, so that a later filter on `masked` is not pushed down to score again
    out = tokens.select("*", F.inline(F.array(F.struct(prefix.alias("__prefix"), core.alias("core"), suffix.alias("__suffix")))))
    out = out.select("*", F.inline(F.array(F.struct(_score(F.col("core"), p).alias("score")))))
    out = out.withColumn("masked", _masked(F.col("core"), F.col("score"), p))
    return out.withColumn("replacement", F.when(F.col("masked"), F.concat("__prefix", pseudonym(F.col("core"), p), "__suffix")).otherwise(F.col(token))).drop("__prefix", "__suffix")


def tokens(df: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """df without text, one row per token that may be masked: n_tokens (all of the text's, on its first row alone) and token, null if none may."""
    p = policy or Policy()
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{NOT_SPACE}+"), 0)
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, F.inline(F.array(F.struct(F.size(pieces).cast("long").alias("__n"), F.filter(pieces, lambda t: may_mask(t, p)).alias("__found")))))
    out = rows.select(*rest, "__n", F.posexplode_outer("__found").alias("__pos", "token"))
    return out.select(*rest, F.when(F.coalesce("__pos", F.lit(0)) == 0, F.col("__n")).otherwise(F.lit(0)).alias("n_tokens"), "token")


def mask_texts(df: DataFrame, key: str | list[str], text: str = "text", policy: Policy | None = None) -> DataFrame:
    """key (one or several columns), text with its PII-shaped tokens replaced (white space as it was), n_scanned, n_masked.

    Nothing is shuffled and keys may repeat. Null text stays null, with no tokens.
    """
    p = policy or Policy()
    keys = [key] if isinstance(key, str) else key

    def marked(piece: Column) -> Column:
        token = F.regexp_replace(piece, f"^{SPACE}+", "")
        prefix, core, suffix = edges(token)
        gap = F.substr(piece, F.lit(1), F.length(piece) - F.length(token))
        hit = F.when(may_mask(token, p), _masked(core, _score(core, p), p)).otherwise(F.lit(False))
        return F.when(hit, F.struct(F.lit(True).alias("hit"), F.concat(gap, prefix, pseudonym(core, p), suffix).alias("text"))).otherwise(F.struct(F.lit(False).alias("hit"), piece.alias("text")))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{SPACE}*{NOT_SPACE}+"), 0)
    tail = F.regexp_extract(text, f"{SPACE}*$", 0)
    rows = df.select(*keys, F.inline(F.array(F.struct(F.transform(pieces, marked).alias("__marked"), tail.alias("__tail")))))
    joined = F.when(F.col("__tail").isNotNull(), F.concat(F.array_join(F.transform("__marked", lambda m: m["text"]), ""), "__tail"))
    return rows.select(*keys, joined.alias(text), F.size("__marked").cast("long").alias("n_scanned"), F.size(F.filter("__marked", lambda m: m["hit"])).cast("long").alias("n_masked"))
