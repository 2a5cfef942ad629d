"""Mixing sources to target weights on a low-discrepancy schedule of equal-token blocks.

Slots are the points of a van der Corput sequence, a whole period of it; each
falls into the share of one source. Documents of a source stand in a shuffled row
that is cut into blocks of equal tokens. The r-th slot of a source takes its r-th
block, starting over at the end of the row. What a source gives is what its slots
take: its target, but for one block, and never more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spark_of

#: Slots per source, on average: a source's share is met to one block, a few hundred-thousandths of all tokens.
SLOTS_PER_SOURCE = 65_536
#: A source is taken three times at most.
MAX_EPOCHS = 3


def n_tokens(text_col: str = "text") -> Column:
    """Words of a text, the size that is mixed by."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target: one row per source of sizes (source, size).

    Sources by code point, null last, weigh 1, 2, 3 and so on again. Targets
    share the sum of all sizes by weight; none exceeds MAX_EPOCHS times its
    source's size, and what is cut off goes to the others by weight. Sources
    are filled in order of limit per unit of weight: the first that can take
    its share of what is left, and all after it, are not limited.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    weighed = weighed.withColumn("room", MAX_EPOCHS * F.col("source_size"))
    order = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = weighed.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum("room").over(before), F.lit(0)).alias("gone"), F.sum("weight").over(after).alias("weights"))
    level = (F.col("total") - F.col("gone")) / F.col("weights")
    levelled = filled.withColumn("level", F.when(F.col("weight") * level <= F.col("room"), level))
    levelled = levelled.withColumn("level", F.max("level").over(everything))
    free = F.col("level").isNotNull() & (F.col("weight") * F.col("level") <= F.col("room"))
    return levelled.select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.when(free, F.col("weight") * F.col("level")).otherwise(F.col("room").cast("double")).alias("target"))


def mirrored(i: Column, bits: int) -> Column:
    """The i-th point of the base-2 sequence in units of 2 ** -bits: the binary digits of i in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def shares(goals: DataFrame, bits: int) -> DataFrame:
    """goals (source_no, quota) with lo and hi: the points from lo to before hi of 2 ** bits are the source's.

    Whole numbers throughout, so that no point depends on rounding; a source
    gets its share of the points to within one.
    """
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = goals.withColumn("upto", F.sum("quota").over(upto)).withColumn("all", F.sum("quota").over(Window.partitionBy()))
    edge = lambda c: F.expr(f"cast((cast({c} as decimal(38, 0)) * {1 << bits} + `all` - 1) div `all` as long)")
    return summed.select(*goals.columns, edge("upto - quota").alias("lo"), edge("upto").alias("hi"))


def schedule(parts: DataFrame, bits: int) -> DataFrame:
    """slot, source_no, rank: which source each of 2 ** bits slots takes from, and its how-manieth slot there. parts: source_no, lo, hi."""
    # a share covers whole cells of a grid, so slots meet shares by an equality and not by a range
    width = 1 << max(0, bits - 12)
    grid = parts.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark_of(parts).range(1 << bits).select(F.col("id").alias("slot"), mirrored(F.col("id"), bits).alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    hit = points.join(grid, "cell").where("point >= lo and point < hi")
    return hit.select("slot", "source_no", (F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1).alias("rank"))


def token_row(sized: DataFrame, id_col: str, buckets: int, seed: str = "mix") -> DataFrame:
    """sized with start: tokens before each document in its source's shuffled row.

    The row is in order of a digest of id and size. Its first digits are a bucket,
    so that running sums are taken inside (source, bucket) and a source with a
    third of all rows is still spread over tasks.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"), F.lit(":" + seed)))
    keyed = sized.withColumn("__key", digest).withColumn("__bucket", (F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    rows = keyed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.join(offsets, rows["source"].eqNullSafe(offsets["__s"]) & (rows["__bucket"] == offsets["__b"]))
    return both.withColumn("start", F.col("__inside") + F.col("__offset")).drop("__key", "__bucket", "__inside", "__s", "__b", "__offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots_per_source: int = SLOTS_PER_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents) of the mix of all rows.

    pieces: slot, id, source, epoch, first, n_tokens: the words [first, first +
    n_tokens) of a document that a slot takes. documents: id, size, source,
    source_size, target, taken (words the pieces take, repeats counted),
    first_slot (the first that takes from it; null if none does).

    Null texts have size 0 and are taken 0 times; null sources are a source,
    the last; repeated rows and null ids are documents of their own; a table
    without words gives targets of 0; other columns are not read. The order
    depends on ids and sizes alone, so reruns agree. A source whose share is
    under one slot still has one, after all others.
    """
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_tokens(text_col).alias("size")), "mix-sizes")
    goals = targets(sized)
    goals = materialize(goals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1), "mix-goals")
    head = goals.agg(F.count("*").alias("n"), F.sum("source_size").alias("total")).first()
    n, total = head["n"], head["total"] or 0
    bits = max(1, math.ceil(math.log2(max(n, 1) * slots_per_source)))
    block = max(1, -(-total // (1 << bits)))
    buckets = max(256, min(1 << 20, total // 1_000_000))
    rows = token_row(sized, "doc_id", int(buckets))
    wanted = goals.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    joined = rows.join(F.broadcast(wanted) if n <= 10_000 else wanted, rows["source"].eqNullSafe(wanted["__source"])).drop("__source")
    joined = materialize(joined.withColumn("row_no", F.monotonically_increasing_id()), "mix-rows")

    # the row repeats itself without end; block r holds its tokens [r * block, (r + 1) * block), up to the quota
    quotas = goals.select("source_no", F.round("target").cast("long").alias("quota"))
    parts = materialize(shares(quotas.where("quota > 0"), bits), "mix-shares")
    spare = parts.where("lo >= hi").select((F.col("source_no") + F.lit(1 << bits)).alias("slot"), "source_no", F.lit(0).alias("rank"))
    slots = schedule(parts, bits).unionByName(spare)
    given = parts.select("source_no", F.least(F.col("quota"), F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * block).alias("given"))
    rows = joined.where("size > 0").join(F.broadcast(given) if n <= 10_000 else given, "source_no")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    rows = rows.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), "given")).where("from < to")
    number = lambda c: F.floor(c / block)
    rows = rows.withColumn("rank", F.explode(F.sequence(number(F.col("from")), number(F.col("to") - 1))))
    lo, hi = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    pieces = rows.select("row_no", "doc_id", "source", "source_no", "epoch", "rank", (lo - F.col("from")).alias("first"), (hi - lo).alias("n_tokens")).join(slots, ["source_no", "rank"])
    pieces = pieces.select("slot", "row_no", "doc_id", "source", "epoch", "first", "n_tokens")
    taken = pieces.groupBy("row_no").agg(F.sum("n_tokens").alias("taken"), F.min("slot").alias("first_slot"))
    out = joined.join(taken, "row_no", "left")
    return pieces, out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
