"""Schedules, logs and retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

# The bounds of the five fields, the levels in order, and rotation intervals in days.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
LEVELS = ("debug", "info", "warn", "error")
ROTATIONS = {"daily": 1, "weekly": 7, "monthly": 30, "yearly": 365}
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _values(field: str, low: int, high: int) -> list[int]:
    found: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else int(a))
        if every < 1 or first < low or last > high or first > last:
            raise ValueError(f"{field!r} is not within {low}-{high}")
        found.update(range(first, last + 1, every))
    return sorted(found)


def parse_cron(schedule: str) -> dict[str, list[int]]:
    """The minutes, hours, days, months and weekdays (Sunday 0) of a schedule; ValueError if it is none."""
    fields = schedule.split()
    if len(fields) != len(FIELDS):
        raise ValueError("a schedule has five fields")
    return {name: _values(f, low, high) for f, (name, low, high) in zip(fields, FIELDS, strict=True)}


def cron_match(ts: Column, schedule: str) -> Column:
    """Whether a schedule is due in the minute of ts. Days and weekdays that are both restricted are alternatives."""
    at = parse_cron(schedule)
    day, weekday = F.dayofmonth(ts).isin(*at["day"]), (F.dayofweek(ts) - 1).isin(*at["weekday"])
    both = len(at["day"]) < 31 and len(at["weekday"]) < 7
    return F.minute(ts).isin(*at["minute"]) & F.hour(ts).isin(*at["hour"]) & F.month(ts).isin(*at["month"]) & ((day | weekday) if both else (day & weekday))


def due_jobs(minutes: DataFrame, schedules: dict[str, str], ts: str = "ts") -> DataFrame:
    """minutes with job, once for each job that is due; schedules that cannot be read are left to job_errors."""
    jobs = []
    for name, schedule in sorted(schedules.items()):
        try:
            jobs.append(F.when(cron_match(F.col(ts), schedule), F.lit(name)))
        except ValueError:
            continue
    return minutes.select("*", F.explode(F.array_compact(F.array(*jobs))).alias("job"))


def schedule_errors(schedules: DataFrame, schedule: str = "schedule") -> DataFrame:
    """schedules with error: why one cannot be read, null if it can. Null schedules have no fields."""
    ship(schedules.sparkSession)

    @F.pandas_udf("string")
    def error(texts: pd.Series) -> pd.Series:
        return pd.Series([job_errors({"": t or ""}).get("") for t in texts], dtype="object")

    return schedules.withColumn("error", error(F.col(schedule)))


def job_errors(schedules: dict[str, str]) -> dict[str, str]:
    """Why a schedule cannot be read, by job."""
    found = {}
    for name, schedule in schedules.items():
        try:
            parse_cron(schedule)
        except ValueError as e:
            found[name] = str(e)
    return found


def humanized(cron: Column) -> Column:
    """The five shapes of schedule that have a name in words; others as they are."""
    f = F.split(F.trim(cron), "\\s+")
    m, h, day, month, wd = (F.get(f, F.lit(i)) for i in range(5))
    number = lambda c: c.rlike("^\\d{1,9}$")
    clock = F.format_string("%02d:%02d", h.try_cast("int"), m.try_cast("int"))
    any_ = lambda *cols: F.array_max(F.array(*[c != "*" for c in cols])) == F.lit(False)
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (
        F.when((F.size(f) != 5) | (month != "*"), cron)
        .when(any_(m, h, day, wd), "Every minute")
        .when(number(m) & any_(h, day, wd), F.format_string("Every hour, at minute %d", m.try_cast("int")))
        .when(number(m) & number(h) & any_(day, wd), F.concat(F.lit("Daily at "), clock))
        .when(number(m) & number(h) & (day == "*") & wd.rlike("^[0-6]$"), F.concat(F.lit("Weekly on "), F.get(names, wd.try_cast("int")), F.lit(" at "), clock))
        .when(number(m) & number(h) & (wd == "*") & day.rlike("^([1-9]|[12]\\d|3[01])$"), F.concat(F.lit("Monthly on day "), day, F.lit(" at "), clock))
        .otherwise(cron)
    )


def level_ordinal(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(level)) - 1


def log_filter(logs: DataFrame, least: str, categories: dict[str, bool] | None = None, level: str = "level", category: str = "category") -> DataFrame:
    """Lines at a level or above, of categories that are on; without any listed, all are."""
    kept = logs.where(level_ordinal(F.col(level)) >= LEVELS.index(least))
    if categories:
        kept = kept.where(F.col(category).isin(*[c for c, on in categories.items() if on]))
    return kept


def log_lines(logs: DataFrame, *columns: str) -> DataFrame:
    """One JSON line per row."""
    return logs.select(F.to_json(F.struct(*columns)).alias("line"))


def rotation_due(started: Column, now: Column, interval: str) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(started) >= ROTATIONS[interval] * 86_400


def expired_logs(files: DataFrame, now: Column, days: int, name: str = "name") -> DataFrame:
    """files with expired: the date in the name is before the cutoff. Names without a date are kept."""
    date = F.try_to_date(F.nullif(F.regexp_extract(name, "(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")))
    return files.withColumn("expired", F.coalesce(date < F.date_sub(now, days), F.lit(False)))


def placeholders(text: Column, now: Column) -> Column:
    """{date} and {time} filled in."""
    return F.replace(F.replace(text, F.lit("{date}"), F.date_format(now, "yyyy-MM-dd")), F.lit("{time}"), F.date_format(now, "HH:mm"))
