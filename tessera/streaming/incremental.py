"""Streaming forms of the operators that build up over time: spend, schedules, repeated lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.jobs import due_jobs
from tessera.operators.sanitize import line_key
from tessera.shipping import shared_dir

RUN = "key string, first string, n long"


def spend_stream(events: DataFrame, by: str, ts: str = "ts", usd: str = "usd", late: str = "7 days") -> DataFrame:
    """Spend per key and day over a stream; the state of days beyond the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(by, F.window(ts, "1 day")).agg(F.sum(usd).alias("usd"), F.count("*").alias("n")).select(by, F.col("window.start").alias("day"), "usd", "n")


def due_stream(ticks: DataFrame, schedules: dict[str, str], ts: str = "ts") -> DataFrame:
    """The jobs that are due at the ticks of a stream; no state and no catching up."""
    return due_jobs(ticks.withColumn(ts, F.date_trunc("minute", ts)), schedules, ts)


def first_seen(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen within the watermark: paragraph dedup over a stream."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def closed_runs(lines: DataFrame, by: str, order: list[str], line: str = "line") -> DataFrame:
    """by, first, n: runs of equal lines (time stamps aside) of a stream, each once a different line has closed it.

    The open run of a key is its only state: its comparison key, first line and length.
    """
    kind = dict(lines.dtypes)[by]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        now, first, n = state.get if state.exists else (None, None, 0)
        done = []
        for k, text in zip(rows["__key"], rows[line], strict=True):
            if n and k == now:
                n += 1
            else:
                if n:
                    done.append((key[0], first, n))
                now, first, n = k, text, 1
        state.update((now, first, n))
        yield pd.DataFrame(done, columns=[by, "first", "n"])

    keyed = lines.withColumn("__key", line_key(F.col(line)))
    return keyed.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, first string, n long", RUN, "append", "NoTimeout")


def drained(stream: DataFrame, spark: SparkSession, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all there is now, and read back what it gave; in complete mode, its last answer."""
    base = f"{folder or shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    put: Callable = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start
    query = put()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
