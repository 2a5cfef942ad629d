"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import materialize, ship

__all__ = ["ascii_lower", "hot_keys", "materialize", "salted_join", "small_batches", "spark_of", "split_words", "table"]

#: ASCII white space as the contracts define words: space, tab, LF, VT, FF, CR.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Keys that salted joins spread at most; rows of a key that are never spread.
HOT_KEYS = 2000
HOT_ROWS = 200


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def hot_keys(sizes: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """keys, salts: the keys of sizes that hold over a two-thousandth of all its rows (HOT_ROWS at least), and over how many salts to spread each.

    A key counts as hot from a share of all rows on, so there are HOT_KEYS of
    them at most, whatever the size: they may be broadcast.
    """
    total = sizes.agg(F.sum(rows)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    return sizes.where(F.col(rows) > most).select(*keys, F.ceil(F.col(rows) / most).cast("int").alias("__salts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right (inner or left), by a shuffle, with rows of hot keys (hot_keys) of left spread over tasks.

    right has few rows of each key; those of hot ones are sent to every salt.
    spread tells rows of a key apart and must be the same on a second run.
    """
    hot = F.broadcast(hot)
    salt = F.pmod(spread, F.coalesce("__salts", F.lit(1))).cast("int")
    salted = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    salts = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    spread_out = right.join(hot, keys, "left").withColumn("__salt", F.explode(salts)).drop("__salts")
    return salted.join(spread_out.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Before Python functions: ship the package, and keep Arrow batches so small that texts of some hundred KB do not fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(c: Column, pattern: str = BLANKS) -> Column:
    """Array of the maximal runs between matches of pattern; empty for null and for texts without words."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), pattern), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
