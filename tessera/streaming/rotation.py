"""A rotated log as a streaming sink: one folder a period, files by batch, periods beyond the retention dropped."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.jobs import ROTATIONS


def plain_line(ts: Column, level: Column, category: Column, message: Column) -> Column:
    """`time [level] [category] message` and a line end."""
    return F.format_string("%s [%s] [%s] %s\n", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), level, category, message)


def structured_line(ts: Column, level: Column, category: Column, message: Column) -> Column:
    """A JSON object and a line end; the time in RFC 3339."""
    time = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.concat(F.to_json(F.struct(time.alias("time"), level.alias("level"), category.alias("category"), message.alias("message"))), F.lit("\n"))


def period_of(ts: Column, interval: str | int) -> Column:
    """First day of the period of ts: periods are runs of days counted from 1970-01-01."""
    days = ROTATIONS[interval] if isinstance(interval, str) else interval
    return F.date_from_unix_date((F.floor(F.unix_date(ts.cast("date")) / days) * days).cast("int"))


def _periods(spark: SparkSession, folder: str) -> dict[date, Callable[[], bool]]:
    """Periods of a rotated log, each with what drops it; through the file system that Spark reads the folder by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    named = {p.getName(): p for p in found if p.getName().startswith("period=")}
    return {date.fromisoformat(n.removeprefix("period=")): lambda p=p: fs.delete(p, True) for n, p in named.items()}


def drop_expired(spark: SparkSession, folder: str, now: date, retention: int) -> list[date]:
    """Drops the periods that began more than `retention` days before now, but for the newest one; returns them."""
    periods = _periods(spark, folder)
    gone = [p for p in sorted(periods) if p < now - timedelta(days=retention) and p != max(periods)]
    for p in gone:
        periods[p]()
    return gone


def rotating_sink(folder: str, interval: str | int = "daily", retention: int = 30, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends rows to the rotated log in folder.

    Rows go to the folder of their period and, in it, to that of their batch. A
    batch that runs again, after a failure, replaces its own files and no other.
    After each batch, periods go that began more than `retention` days before
    the newest row. Rows without a time are of the period of 1970.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = F.coalesce(F.col(ts), F.to_timestamp(F.lit("1970-01-01")))
        rows = batch.withColumns({"period": period_of(at, interval), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(folder)
        periods = _periods(spark, folder)
        if periods:
            newest = spark.read.schema(batch.schema).parquet(f"{folder}/period={max(periods).isoformat()}").agg(F.max(F.col(ts).cast("date")).alias("d")).first()["d"]
            drop_expired(spark, folder, newest or max(periods), retention)

    return put


def rotated_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a rotated log, with period."""
    return spark.read.schema(f"{schema}, period date, batch int").parquet(folder).drop("batch")
