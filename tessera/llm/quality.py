"""Quality rules as a bitmask ledger: every rule once per document, policies over the stored bits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_words

SYMBOLS = "#*$%&|<>"
#: How a line of a list begins, and how one ends that was cut off.
BULLET = "^[ \t]*[-*\u2022\u00B7]"
ELLIPSIS = "(\\.\\.\\.|\u2026)[ \t\r]*$"


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failed`, SQL over the measurements, is true. Bits are part of stored ledgers: never renumber."""

    name: str
    bit: int
    failed: str


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a document goes if it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_trigrams", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule("short_words", 4, "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", 5, "n_words > 0 and word_chars > 20 * n_words"),
    # bit 6 was a rule that bit 0 implies; the number is not used again
    Rule("few_letters", 7, "n_words > 0 and 2 * n_letters < word_chars"),
    Rule("bullet_lines", 8, "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipsis_lines", 9, "n_lines >= 4 and 10 * n_ellipsis_lines > 3 * n_lines"),
)
BASE = Policy("base", 1, ("too_few_words", "repeated_trigrams"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def _sorted_windows(words: Column) -> Column:
    """The three-word windows as (hash, position), in order, so that equal ones are neighbours; empty if all differ."""
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    n = F.size(words) - 2
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n > 1, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)


def _repeated_positions(hashes: Column, positions: Column) -> Column:
    """Ascending positions of the windows that occur twice or more; hashes are in order, positions beside them."""
    n = F.size(hashes)
    same = lambda a, b: F.coalesce(F.get(hashes, a) == F.get(hashes, b), F.lit(False))
    found = F.filter(positions, lambda _, k: same(k, k - 1) | same(k, k + 1))
    return F.when(n > 1, F.sort_array(found)).otherwise(F.array().cast("array<int>"))


def _covered(at: Column) -> Column:
    """Words inside the three-word windows that start at the ascending positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(at, start, step, lambda a: a["n"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_bullet_lines", "n_ellipsis_lines")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the MEASURES, all long, in place of columns of these names.

    n_repeat_words: words inside three-word windows that occur twice or more in
    the text; windows are told apart by 64 bits of hash. n_letters: letters of
    any script. n_bullet_lines, n_ellipsis_lines: lines with a word that begin
    with a bullet, or end in an ellipsis. Null text has no words and no lines. Nothing is shuffled: each
    document is measured inside its own row, in n log n of its words.
    """
    docs = docs.drop(*(set(MEASURES) & set(docs.columns)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select("*", split_words(text).alias("__words"), lines.alias("__lines"))
    out = out.withColumn("__windows", _sorted_windows(F.col("__words")))
    # transform() and not a field of the array: Catalyst would copy the latter into each step of the next lambda
    out = out.select("*", F.transform("__windows", lambda w: w["h"]).alias("__h"), F.transform("__windows", lambda w: w["i"]).alias("__i"))
    out = out.withColumn("__at", _repeated_positions(F.col("__h"), F.col("__i")))
    found = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__at")).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("__lines", lambda s: s.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__lines", lambda s: s.rlike(ELLIPSIS))).cast("long").alias("n_ellipsis_lines"),
    )
    # inline() of one struct, and not plain columns: a later filter would be pushed down and measure everything again
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(found)))


def ledger(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with its measurements and fail_bits: bit b is set where the rule of bit b fails.

    Columns of docs keep their names; a clashing one (say, an n_words of its
    own) is replaced by the measurement. Null ids and repeated rows stay rows.
    """
    measured = measure(docs.drop("fail_bits"), text_col)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[name] for name in policy.rules)


def kept(policy: Policy, bits: Column | None = None, rules: Sequence[Rule] = RULES) -> Column:
    """True where a document of a ledger passes the policy."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(ledger_rows: DataFrame, policy: Policy = STANDARD, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects (kept if it were left out).

    The ledger is first counted by its bits, so only one row per combination
    of failures is left, whatever the number of documents.
    """
    combos = ledger_rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    inside = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    sums = []
    for r in rules:
        if r.name in policy.rules:
            bit = F.lit(1 << r.bit).cast("long")
            failed = F.sum(F.when(inside.bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
            alone = F.sum(F.when(inside == bit, F.col("n")).otherwise(0))
            sums.append(F.struct(F.lit(r.name).alias("rule"), F.lit(policy.version).alias("policy_version"), F.coalesce(failed, F.lit(0)).alias("n_failed"), F.coalesce(alone, F.lit(0)).alias("n_only")))
    return combos.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def quality_report(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, measurements, fail_bits, base_failed and kept."""
    rows = ledger(docs.select(F.col(id_col), F.col(text_col)), text_col)
    base_failed = ~kept(BASE)
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (kept(BASE) & kept(policy)).alias("kept"), "fail_bits", *MEASURES[6:], "n_lines")
